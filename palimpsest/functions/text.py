"""Text expressions: tokens, views, estimates, overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the lexical index.
STOP_WORDS = sorted(
    set(
        """the a an and or but in on at to for of with by is are was were am be been being have has had having do does did doing will would could
        should may might can this that these those i you he she it we they me him her us them my your his its our their myself yourself himself
        herself itself ourselves yourselves themselves here there where everywhere somewhere nowhere above below under over between among through
        into onto upon within without very quite rather really too so such much many more most less least few little some any all both each every
        either neither another other same different um uh oh ah yeah yes no okay ok well like just actually basically literally obviously
        definitely probably maybe perhaps suppose guess think know see look listen hear however therefore moreover furthermore nevertheless
        nonetheless meanwhile otherwise besides instead though although because since as if unless whether while whereas
        的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 当 下 想 出 那 里 以 时候 把 行 比 但是 他 她 它 我们 你们 他们 她们 它们
        这个 那个 这些 那些 什么 怎么 为什么 哪里 什么时候 多少 怎样 如何 或者 还是 然后 所以 因为 虽然 如果 只要 嗯 啊 哦 呃 额 这样 那样 好的 知道 明白 对 不对 可以 不可以 应该 可能""".split()
    )
)
WORD = r"[\p{L}\p{N}_]+"
TEXT_FIELDS = ("text_content", "content", "description", "summary", "title", "message")


def tokens(text: Column) -> Column:
    """The terms of a text: lower-cased runs of letters, digits and underscores, without stop words and
    without single characters that aren't digits. Null gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(WORD), 0)
    return F.filter(words, lambda w: ((F.length(w) > 1) | w.rlike("^[0-9]$")) & ~w.isin(*STOP_WORDS))


def text_view(raw: Column, uid: Column, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """What a record's payload (a map) reads as: its first text field that isn't empty, else its fields
    as 'key: value', else a name made from the uid."""
    first = F.coalesce(*[F.nullif(F.try_element_at(raw, F.lit(f)), F.lit("")) for f in fields])
    listed = F.array_join(F.array_sort(F.transform(F.filter(F.map_entries(raw), lambda e: (e.key != "embedding") & e.value.isNotNull()), lambda e: F.concat(e.key, F.lit(": "), e.value))), "; ")
    found = F.coalesce(first, F.nullif(listed, F.lit("")), F.concat(F.lit("Unit "), uid))
    return F.when(F.trim(found) == "", F.concat(F.lit("Memory unit "), uid)).otherwise(found)


def token_estimate(text: Column) -> Column:
    """Tokens of a text by kind of character: 0.6 for a CJK ideograph, 0.3 for a Latin letter, 0.4 for any other."""
    t = F.coalesce(text, F.lit(""))
    cjk, latin = F.regexp_count(t, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    # In tenths, so that no rounding error reaches the floor.
    return F.floor((cjk * 6 + latin * 3 + (F.length(t) - cjk - latin) * 4) / 10).cast("bigint")


def relevance(text: Column, query: Column) -> Column:
    """The share of a query's white-space words, repeats counted, that occur in a text as substrings; 0 for an empty one."""
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    low = F.lower(F.coalesce(text, F.lit("")))
    # Bound as an array of one, so that the text is lower-cased and the query split once a pair, not once a word.
    share = lambda x: F.when(F.size(x.words) > 0, F.size(F.filter(x.words, lambda w: F.contains(x.low, w))) / F.size(x.words)).otherwise(0.0)
    return F.transform(F.array(F.struct(words.alias("words"), low.alias("low"))), share)[0]


def normalized_answer(text: Column) -> Column:
    """The words of an answer: without commas, punctuation and articles, lower-cased."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(F.regexp_replace(bare, r"\b(a|an|the|and)\b", " "), r"\s+"), lambda w: w != "")


def exact_match(a: Column, b: Column) -> Column:
    """Whether two answers have the same set of words."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def token_f1(gold: Column, answer: Column) -> Column:
    """F1 of the bags of words of two answers; 0 if nothing is shared."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    same = F.aggregate(F.array_distinct(gold), F.lit(0), lambda acc, w: acc + F.least(count(gold, w), count(answer, w)))
    p, r = F.try_divide(same, F.size(answer)), F.try_divide(same, F.size(gold))
    return F.when(same > 0, 2 * p * r / (p + r)).otherwise(0.0)


def safe_id(text: Column) -> Column:
    """An id with signs other than letters, digits and ``_.:-`` as underscores."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.:-]+", "_")

