"""Rules that sort questions into categories, and tables that give each category its towers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the two classifiers, in order.
LOCOMO_RULES: list[tuple[int, str]] = [
    (2, r"^when\b"),
    (3, r"\bwould\b|\bcould\b|\blikely\b|\bprobably\b|\bif\s+(she|he|they|it)\b|\bwhat\s+(would|could|might)\b|\bdo\s+you\s+think\b|\bis\s+it\s+(likely|possible|probable)\b|\bconsidered\s+a\b"),
    (4, r"^what\s+is\b|^what\s+was\b|^what\s+does\b|^who\s+is\b|^who\s+was\b|^where\s+is\b|^where\s+does\b|^where\s+did\b.*\bmove\b"),
    (1, r"^how\b|^why\b|^what\s+(did|are|were)\b"),
]
LONGMEMEVAL_TEMPORAL = r"\bwhen\b|\bbefore\b|\bafter\b|\bfirst\b|\blast\b|\btimeline\b|\bchronolog|\border\b|\bearlier\b|\blater\b|\brecent\b|\blatest\b|\bhow\s+long\b|\bsince\s+when\b"
LONGMEMEVAL_UPDATE = (r"\bupdate[ds]?\b", r"\bchange[ds]?\b", r"\bnow\b", r"\bcurrent(ly)?\b", r"\bstill\b", r"\bused\s+to\b", r"\bno\s+longer\b", r"\binstead\b", r"\breplace[ds]?\b", r"\bswitch(ed)?\b")
LONGMEMEVAL_PREFERENCE = r"\bprefer(s|red|ence)?\b|\bfavorite\b|\bfavourite\b|\blike[sd]?\s+(more|most|best|better)\b|\bdislike[sd]?\b|\bhate[sd]?\b"
# Fixed values: (model, strategy, category) -> hierarchical, graph, episodic top-k and the final top-k; 0 is a tower that isn't asked.
LOCOMO_ROUTES = [("gpt-4o-mini", "aggressive", 1, 15, 0, 30, 20), ("gpt-4o-mini", "aggressive", 2, 15, 30, 0, 20), ("gpt-4o-mini", "aggressive", 5, 0, 30, 30, 35), ("gpt-4o-mini", "conservative", 5, 0, 30, 30, 35)]
LOCOMO_DEFAULT = (15, 30, 30, 20)


def locomo_category(question: Column) -> Column:
    """1 aggregation, 2 temporal, 3 open domain, 4 simple fact. A fact question of more than 12 words isn't simple by its first words."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    short = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 12
    out = F.when(q.rlike(LOCOMO_RULES[0][1]), 2).when(q.rlike(LOCOMO_RULES[1][1]), 3).when(q.rlike(LOCOMO_RULES[2][1]) & short, 4).when(q.rlike(LOCOMO_RULES[3][1]), 1)
    return out.otherwise(4)


def longmemeval_category(question: Column) -> Column:
    """temporal-reasoning, knowledge-update (two signs of it), single-session-preference, else multi-session."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    updates = sum((F.when(q.rlike(p), 1).otherwise(0) for p in LONGMEMEVAL_UPDATE), F.lit(0))
    return F.when(q.rlike(LONGMEMEVAL_TEMPORAL), "temporal-reasoning").when(updates >= 2, "knowledge-update").when(q.rlike(LONGMEMEVAL_PREFERENCE), "single-session-preference").otherwise("multi-session")


def routed(questions: DataFrame, model: str = "gpt-4o-mini", strategy: str = "aggressive", category: str = "category") -> DataFrame:
    """Questions with ``hierarchical_k, graph_k, episodic_k, final_k``. Unknown models containing '4o' are taken for gpt-4o-mini, others ask all towers."""
    known = "gpt-4o-mini" if "4o" in model else model
    rows = [r for r in LOCOMO_ROUTES if r[0] == known and r[1] == strategy]
    pick = lambda i: F.coalesce(*[F.when(F.col(category) == r[2], r[3 + i]) for r in rows], F.lit(LOCOMO_DEFAULT[i]))
    return questions.select("*", *(pick(i).alias(n) for i, n in enumerate(("hierarchical_k", "graph_k", "episodic_k", "final_k"))))


# Model, strategy, the towers asked for each category in this order (S sentences, E episodes, N entities), the final top-k; and how many each tower is asked for.
LONGMEMEVAL_CATEGORIES = ("multi-session", "temporal-reasoning", "knowledge-update", "single-session-user", "single-session-assistant", "single-session-preference")
LONGMEMEVAL_ROUTES = [
    ("gpt-4.1-mini", "aggressive", "SE SE SN EN SEN SEN", 25),
    ("gpt-4.1-mini", "conservative", "SE SE SN SEN SEN SEN", 25),
    ("gpt-4o-mini", "aggressive", "EN SEN SEN EN SEN SN", 25),
    ("gpt-4o-mini", "conservative", "EN SEN SEN SEN SEN SEN", 25),
    ("gpt-5", "aggressive", "SN SE SN SN SE SEN", 50),
    ("gpt-5", "conservative", "SEN SE SN SN SE SEN", 50),
]
LONGMEMEVAL_SIZES = {"S": 60, "N": 40, "E": 40}
LONGMEMEVAL_FINAL = 25


def longmemeval_routed(questions: DataFrame, model: str = "gpt-4.1-mini", strategy: str = "aggressive", category: str = "category") -> DataFrame:
    """The same for the other data set. Unknown models are taken for the one whose version they name (5, 4.1, 4o), else for gpt-4.1-mini; an unknown category asks all towers."""
    low = model.lower()
    known = "gpt-5" if "gpt-5" in low or "gpt5" in low else "gpt-4.1-mini" if "4.1" in low else "gpt-4o-mini" if "4o" in low else "gpt-4.1-mini"
    towers, final = next((t.split(), k) for m, s, t, k in LONGMEMEVAL_ROUTES if m == known and s == ("conservative" if strategy == "conservative" else "aggressive"))
    said = F.lower(F.trim(F.col(category).cast("string")))
    asked = F.coalesce(*[F.when(said == c, t) for c, t in zip(LONGMEMEVAL_CATEGORIES, towers, strict=True)], F.lit("SEN"))
    size = lambda letter: F.when(F.contains(asked, F.lit(letter)), LONGMEMEVAL_SIZES[letter]).otherwise(0)
    final_k = F.when(said.isin(*LONGMEMEVAL_CATEGORIES), final).otherwise(LONGMEMEVAL_FINAL)
    return questions.select("*", size("S").alias("hierarchical_k"), size("N").alias("graph_k"), size("E").alias("episodic_k"), final_k.alias("final_k"))


TOWER_SIZES = ("hierarchical_k", "graph_k", "episodic_k")


def tower_weights(routes: DataFrame) -> DataFrame:
    """Routes with the weights of their towers: a third each (0.34, 0.33, 0.33) for three, a half each for two, 0 for those that aren't asked."""
    asked = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in TOWER_SIZES), F.lit(0))
    weight = lambda c, third: F.when(F.col(c) == 0, 0.0).when(asked == 3, third).when(asked == 2, 0.5).otherwise(1.0)
    return routes.select("*", *(weight(c, third).alias(c.replace("_k", "_weight")) for c, third in zip(TOWER_SIZES, (0.34, 0.33, 0.33), strict=True)))


def route_decisions(questions: DataFrame, dataset: str, sizes: tuple[int, int, int, int] = (20, 20, 20, 20), routing: bool = True, only: str | None = None, model: str = "gpt-4o-mini", strategy: str = "aggressive") -> DataFrame:
    """``questions`` (``question``, and ``category`` where it is stated) with ``active`` towers, their ``_k``, ``final_k``, ``confidence`` and ``reason``.

    Without routing, or if only one tower is asked (``only``: hierarchical, graph or episodic), the configured sizes hold, with confidence 1. Else a stated category is
    routed with confidence 0.9 and one told from the question with 0.65; a tower that isn't asked keeps its configured size, unused.
    """
    names = [c.replace("_k", "") for c in TOWER_SIZES]
    if not routing or only is not None:
        active = ",".join(n for n in names if only in (None, n))
        return questions.select("*", F.lit(active).alias("active"), *(F.lit(k).alias(c) for c, k in zip((*TOWER_SIZES, "final_k"), sizes, strict=True)), F.lit(1.0).alias("confidence"), F.lit("search_mode_override").alias("reason"))
    stated = F.col("category").isNotNull()
    told = questions.withColumn("_category", F.coalesce("category", longmemeval_category(F.col("question")) if dataset == "longmemeval" else locomo_category(F.col("question"))))
    found = longmemeval_routed(told, model, strategy, "_category") if dataset == "longmemeval" else routed(told, model, strategy, "_category")
    active = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, n) for c, n in zip(TOWER_SIZES, names, strict=True)])), ",")
    k = lambda c, size: F.when(F.col(c) > 0, F.col(c)).otherwise(size).alias(c)
    return found.select(
        *questions.columns, active.alias("active"), *(k(c, size) for c, size in zip((*TOWER_SIZES, "final_k"), sizes, strict=True)),
        F.when(stated, 0.9).otherwise(0.65).alias("confidence"), F.when(stated, "category_router").otherwise("router_inferred_category").alias("reason"),
    )


def routing_statistics(questions: DataFrame, category: str = "category") -> DataFrame:
    """By category: questions and their share of all."""
    total = questions.agg(F.count("*").alias("all"))  # one row
    return questions.groupBy(category).agg(F.count("*").alias("questions")).crossJoin(F.broadcast(total)).select(category, "questions", (F.col("questions") / F.col("all")).alias("share"))


# Categories by how much evidence they need, and the parameters of each kind of cut (drop below, stop at, least chunks, share of the budget, most drops).
CHAIN_WORDS = ("multi-session", "multi_session", "multisession", "temporal-reasoning", "temporal_reasoning", "aggregation", "adversarial")
AGGRESSIVE_WORDS = ("single-session-user", "single-session-preference", "single_session_user", "single_session_preference", "simple_fact", "simplefact", "open_domain", "opendomain")
CUTS = {"AGGRESSIVE_CUT": (0.6, 1.2, 2, 0.8, None), "MODERATE_CUT": (1.0, 1.8, 4, 0.9, 5), "EVIDENCE_CHAIN": (1.8, 2.5, 6, 1.0, None)}


def cut_of(category: Column) -> Column:
    """EVIDENCE_CHAIN, AGGRESSIVE_CUT or MODERATE_CUT by the words in a category's name; MODERATE_CUT for all others."""
    low = F.lower(F.coalesce(category.cast("string"), F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return F.when(has(CHAIN_WORDS), "EVIDENCE_CHAIN").when(has(AGGRESSIVE_WORDS), "AGGRESSIVE_CUT").otherwise("MODERATE_CUT")


def with_cut(questions: DataFrame, category: str = "category") -> DataFrame:
    """Questions with the parameters of their kind of cut."""
    x = questions.withColumn("cut", cut_of(F.col(category)))
    pick = lambda i, kind: F.coalesce(*[F.when(F.col("cut") == n, F.lit(v[i])) for n, v in CUTS.items() if v[i] is not None]).cast(kind)
    names = (("drop_factor", "double"), ("stop_factor", "double"), ("least_chunks", "int"), ("budget_share", "double"), ("most_drops", "int"))
    return x.select("*", *(pick(i, kind).alias(n) for i, (n, kind) in enumerate(names)))
