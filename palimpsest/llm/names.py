"""Variant spellings of names: linked by an exact radius join in a metric space, cell by cell."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.session import Scratch, ship, written

#: Keys that a cell is meant to have; a group gets a pivot for so many of its keys.
CELL_SIZE = 16
#: Longer keys aren't measured against pivots but lie in cells by length, which is the distance from the empty key.
LONGEST_MEASURED = 64
#: Keys of a group, and members of a group of entities, that one task compares with the others.
SALT_ROWS = 50_000

# Short forms of given names.
NICKNAMES: dict[str, str] = {
    "abigail": "abby abbie gail", "albert": "al bert bertie", "alexander": "alex al sasha xander sandy lex", "alexandra": "alex sasha sandra lexi",
    "alfred": "alf alfie fred", "amanda": "mandy", "andrew": "andy drew", "anthony": "tony ant", "antonio": "tony", "arthur": "art artie",
    "barbara": "barb babs barbie", "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad", "bridget": "biddy bridie", "caroline": "carrie caro",
    "catherine": "cathy cate kate katie kit kitty cat", "charles": "charlie chuck chas", "charlotte": "charlie lottie", "christina": "chris tina chrissy", "christine": "chris chrissy tina",
    "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny", "danielle": "dani", "david": "dave davy davey", "deborah": "deb debbie debby", "dennis": "den denny",
    "donald": "don donnie", "dorothy": "dot dottie dolly", "douglas": "doug", "edmund": "ed eddie ned ted", "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nellie nora ella", "elizabeth": "liz lizzie beth betty eliza betsy libby lisa",
    "emily": "em emmy", "eugene": "gene", "florence": "flo flossie", "frances": "fran frannie frankie", "francesca": "fran frankie franny chess", "francis": "frank fran frankie", "franklin": "frank", "frederick": "fred freddie freddy", "gabriel": "gabe",
    "gabriella": "gabby gabi ella", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg gregg", "harold": "harry hal", "helen": "nell nellie lena", "henry": "harry hank hal",
    "isabel": "izzy bella", "isabella": "izzy bella belle isa", "jacob": "jake", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny jenn",
    "jeremy": "jerry", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny nathan", "joseph": "joe joey jo", "josephine": "jo josie josey", "joshua": "josh", "judith": "judy judi jude", "julia": "jules", "katherine": "kate kathy katie kit kitty kat kath",
    "kathleen": "kathy kath kate", "kenneth": "ken kenny", "kimberly": "kim kimmy", "lawrence": "larry laurie lars", "leonard": "len lenny leo", "lillian": "lily lil", "louis": "lou louie", "lucy": "lu", "madeleine": "maddie", "margaret": "maggie meg peg peggy marge margie greta daisy", "martin": "marty",
    "mary": "molly polly mae", "matthew": "matt matty", "maximilian": "max", "michael": "mike mick mickey mikey", "michelle": "shelly", "mildred": "millie", "nancy": "nan", "natalie": "nat", "nathan": "nat nate", "nathaniel": "nat nate nathan", "nicholas": "nick nicky nico", "nicole": "nicky nikki",
    "oliver": "ollie olly", "pamela": "pam", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy rick", "penelope": "penny pen nell", "peter": "pete", "philip": "phil pip", "phillip": "phil pip", "priscilla": "cilla", "rachel": "rach", "randolph": "randy", "raymond": "ray", "rebecca": "becky becca beck", "richard": "rick rich dick richie ricky",
    "robert": "bob bobby rob robbie bert", "roger": "rodge", "ronald": "ron ronnie", "russell": "russ", "samantha": "sam sammy", "samuel": "sam sammy", "sandra": "sandy", "sebastian": "seb bastian baz", "sarah": "sally sadie", "solomon": "sol", "stanley": "stan", "stephanie": "steph", "stephen": "steve stevie ste", "steven": "steve stevie", "susan": "sue susie suzy",
    "susanna": "sue susie suzy anna sanna", "sylvia": "syl", "terence": "terry", "theodore": "ted teddy theo", "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim timmy", "valerie": "val", "veronica": "ronnie vera", "victor": "vic", "victoria": "vicky tori vic vicki", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally",
    "wilfred": "wilf fred", "william": "bill billy will willy liam", "winifred": "winnie win freda", "zachary": "zack zach zac",
}
# Titles and endings of personal names.
TITLES = set("dr prof professor mr mrs ms miss mx sir dame lord lady capt captain rev reverend fr hon judge sgt lt col gen maj cpl pvt cdr eng ing dipl mag pres".split())
SUFFIXES = set("jr sr ii iii iv phd md esq bsc msc mba dds".split())
# Legal forms of organisations and their short forms.
LEGAL_FORMS: dict[str, str] = {
    "incorporated": "inc incorp", "limited": "ltd", "company": "co comp coy", "corporation": "corp", "group": "grp gp", "foundation": "fdn found fnd fdtn", "institute": "inst", "cooperative": "coop co-op cooperativ",
    "association": "assoc assn", "partnership": "lp", "partners": "ptnrs", "holdings": "hldgs holding", "llc": "", "llp": "", "plc": "", "gmbh": "", "ag": "", "sa": "", "bv": "", "society": "soc", "trust": "tr", "university": "univ uni",
}
LEGAL = {short: long for long, shorts in LEGAL_FORMS.items() for short in [long, *shorts.split()]}
FORMAL = {short: sorted({f for f, s in NICKNAMES.items() if short in s.split()}) for s in NICKNAMES.values() for short in s.split()}
NOISE = {"the", "and", "of", "for", "&"}


def plain(name: str) -> str:
    """Without accents, with single spaces."""
    out = unicodedata.normalize("NFKD", name)
    out = "".join(c for c in out if not unicodedata.combining(c))
    for a, b in (("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("’", "'"), ("æ", "ae"), ("đ", "d"), ("ı", "i")):
        out = out.replace(a, b)
    return re.sub(r"[\s_]+", " ", out).strip()


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes ``a`` into ``b`` (or none does)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@lru_cache(maxsize=200_000)
def given_names(token: str) -> tuple[str, ...]:
    """The formal given names a token may stand for: itself, those it is short for, or those one typing
    error away; empty if none is known."""
    exact = set(FORMAL.get(token, ()))
    if token in NICKNAMES:
        exact.add(token)
    if not exact and len(token) >= 4:
        exact = {f for f in NICKNAMES if one_edit(token, f)}
        if not exact:
            exact = {f for short, formal in FORMAL.items() if len(short) >= 5 and one_edit(token, short) for f in formal}
    return tuple(sorted(exact))


def _person(raw: str) -> list[tuple]:
    """Readings ``(kind, key, names, firsts, rest, legal)`` of a person's spelling: kind 'full' or
    'initial', key the surname, names the possible given names, firsts their first letters."""
    text = plain(raw)
    if text.startswith("@") and re.fullmatch(r"@[A-Za-z]{4,}", text):
        word = text[1:].lower()
        return [("initial", word[1:], [], [word[0]], [], "")]
    text = text.lstrip("@")
    if "," in text:
        last, _, first = text.partition(",")
        if first.strip().lower().rstrip(".") not in SUFFIXES:
            text = f"{first.strip()} {last.strip()}"
            comma = True
        else:
            text, comma = last, False
    else:
        comma = False
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    text = re.sub(r"(?<=\w\w)[._](?=\w\w)", " ", text)
    text = re.sub(r"(?<=\b\w)\.(?=\w)", ". ", text)
    tokens = [t.strip(".,;:()\"'").lower() for t in text.split()]
    tokens = [t for t in tokens if t]
    while tokens and tokens[0] in TITLES and len(tokens) > 1:
        tokens = tokens[1:]
    while tokens and tokens[-1] in SUFFIXES and len(tokens) > 2:
        tokens = tokens[:-1]
    initials = [t for t in tokens if len(t) == 1]
    words = [t for t in tokens if len(t) > 1]
    if not words:
        return []
    if len(words) == 1:
        surname = words[0].replace("-", "")
        return [("initial", surname, [], [initials[0]], [], "")] if initials and len(surname) >= 4 else []

    def reading(given: str, rest: list[str]) -> tuple:
        known = given_names(given)
        return ("full", "".join(rest).replace("-", ""), list(known) or ["?" + given], sorted({given[0], *(f[0] for f in known)}), [], "")

    if comma:
        cut = len(words) - 1 if not given_names(words[0]) else 1
        return [reading(words[0], words[cut:] if cut == 1 else words[1:])]
    front, back = bool(given_names(words[0])), bool(given_names(words[-1]))
    if front and not back:
        return [reading(words[0], words[1:])]
    if back and not front:
        return [reading(words[-1], words[:-1])]
    out = [reading(words[0], words[1:])]
    return out if front else [*out, reading(words[-1], words[:-1])]


def _organisation(raw: str) -> list[tuple]:
    """Readings of an organisation's spelling: one for each of its words as key, the others as rest, with a
    pattern where a word is shortened; or the letters of an acronym."""
    text = plain(raw)
    if re.fullmatch(r"(?:[A-Z]\.?){2,5}", text):
        return [("acronym", text.replace(".", "").lower(), [], [], [], "")]
    text = re.sub(r"(?i)&\s*co\b\.?|\band co\b\.?", " ", text)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    text = re.sub(r"(?i)\bco-op\b", "coop", text)
    words, legal = [], ""
    for t in re.split(r"[\s,()/\-]+", text):
        w = t.strip("'\"&;:").lower()
        bare = w.strip(".")
        if not bare or bare in NOISE:
            continue
        if bare in LEGAL or (len(bare) > 6 and any(len(x) > 6 and one_edit(bare, x) for x in LEGAL_FORMS)):
            legal = LEGAL.get(bare) or next(x for x in LEGAL_FORMS if len(x) > 6 and one_edit(bare, x))
        else:
            words.append((bare, w.endswith(".")))
    out = []
    for i, (key, short) in enumerate(words):
        if short or len(key) < 4:
            continue
        rest = [(w, "^" + "[a-z]*".join(map(re.escape, w)) if s else "") for j, (w, s) in enumerate(words) if j != i]
        letters = [key[0] + "".join(w[0] for w, _ in rest) + legal[:1]]
        out.append(("full", key, [], letters, sorted(rest), legal))
    return out


READING = "entity_id string, sample_id string, entity_type string, kind string, key string, names array<string>, firsts array<string>, rest array<struct<word:string,short:string>>, legal string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parse = {"Person": lru_cache(100_000)(lambda x: _person(x)), "Organization": lru_cache(100_000)(lambda x: _organisation(x))}
    for b in batches:
        rows = [
            (e, s, t, kind, key, names, firsts, [{"word": w, "short": p} for w, p in rest], legal)
            for e, s, t, text in zip(b["entity_id"], b["sample_id"], b["entity_type"], b["spelling"], strict=True)
            for kind, key, names, firsts, rest, legal in parse[t](text)
        ]
        yield pd.DataFrame(rows, columns=["entity_id", "sample_id", "entity_type", "kind", "key", "names", "firsts", "rest", "legal"])


def readings(entities: DataFrame) -> DataFrame:
    """How each spelling (name or alias) of each person or organisation may be read. Null and blank
    spellings, and rows without an id or a sample, have no reading."""
    ship(entities.sparkSession)
    spelled = entities.where("entity_id is not null and sample_id is not null and entity_type in ('Person', 'Organization')").select(
        "entity_id", "sample_id", "entity_type", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling")
    )
    return spelled.where("trim(spelling) <> ''").distinct().mapInPandas(_read, READING)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the true edit distance (insertions, deletions, substitutions, swaps of neighbours) is 1 at most."""
    d = F.levenshtein(a, b, 2)
    apart = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    swapped = (F.size(apart) == 2) & (F.get(apart, F.lit(1)) - F.get(apart, F.lit(0)) == 1) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when((d >= 0) & (d <= 1), True).when((d == 2) & (F.length(a) == F.length(b)), swapped).otherwise(False)


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The distance of each pair: least insertions, deletions, substitutions and swaps of neighbours, where a
    swapped pair may be edited further. That makes it a metric, so the triangle inequality holds."""
    order = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    out = np.zeros(len(a), dtype=np.int16)
    rank = np.argsort(order, kind="stable")
    for at in range(0, len(rank), 20_000):  # pairs of about the same length together
        part = rank[at : at + 20_000]
        out[part] = _distances([a[i] for i in part], [b[i] for i in part])
    return out


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.zeros((len(words), max(1, int(lengths.max()))), dtype=np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, lengths


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    x, nx = _padded(a)
    y, ny = _padded(b)
    n, every = len(a), np.arange(len(a))
    cost = np.zeros((x.shape[1] + 1, y.shape[1] + 1, n), dtype=np.int16)
    cost[:, 0] = np.arange(x.shape[1] + 1, dtype=np.int16)[:, None]
    cost[0] = np.arange(y.shape[1] + 1, dtype=np.int16)[:, None]
    row_of = np.zeros((y.shape[1] + 1, n), dtype=np.int64)  # the last row before with the column's character
    for i in range(1, x.shape[1] + 1):
        column_of = np.zeros(n, dtype=np.int64)  # the last column before with the row's character
        for j in range(1, y.shape[1] + 1):
            same = x[:, i - 1] == y[:, j - 1]
            best = np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1, cost[i - 1, j - 1] + ~same)
            r, c = row_of[j], column_of
            can = np.flatnonzero((r > 0) & (c > 0))
            if len(can):
                swap = cost[r[can] - 1, c[can] - 1, can] + (i - r[can] - 1) + (j - c[can] - 1) + 1
                best[can] = np.minimum(best[can], swap)
            cost[i, j] = best
            column_of = np.where(same, j, column_of)
            row_of[j] = np.where(same, i, row_of[j])
    return cost[nx, ny, every]


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of keys (``group, key, parts, pivots``): the nearest pivot's, its home, and those within the bound."""
    for batch in batches:
        keys, lists = batch.column(1).to_pylist(), batch.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        pivots = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].to_pylist()
        row = np.repeat(np.arange(len(keys)), sizes)
        d = edit_distances([keys[i] for i in row], pivots)
        first = np.cumsum(sizes) - sizes
        nearest = np.minimum.reduceat(d, first) if len(d) else d
        at = np.flatnonzero(d <= nearest[row] + 2)
        # The home is the first of the nearest pivots; a key has one.
        closest = np.flatnonzero(d == nearest[row])
        home = closest[np.r_[True, row[closest][1:] != row[closest][:-1]]] if len(closest) else closest
        own = np.isin(at, home)
        at_row = pa.array(row[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at_row), batch.column(1).take(at_row), batch.column(2).take(at_row), pa.array([pivots[i] for i in at], pa.string()), pa.array(own), pa.array(d[at].astype(np.int32))],
            names=["group", "key", "parts", "cell", "own", "d"],
        )


PLACED = "group string, key string, parts int, cell string, own boolean, d int"


def cells(keys: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """Metric-space partitioning of ``group, key, n`` (``n`` spellings have the key): ``group, key, parts, cell, own, d``.

    Every group has pivots, one for each ``cell_size`` of its keys up to the square of ``cell_size``, then as many as the root of
    the number of keys, so that neither the pivots nor a cell grow faster than that. A pivot is the commonest
    key of its share of the keys by hash. A key's home is the cell of the nearest pivot, at distance d, and the
    key is copied into every cell whose pivot is within d + 2: if a partner within distance 1 has its home at
    p, it is at most d + 1 from p by the triangle inequality, or p wouldn't be its nearest, so the key is at most d + 2 from p.
    ``parts`` is over how many tasks the comparisons of a large group's cells are spread.
    """
    ship(keys.sparkSession)
    size = keys.groupBy("group").agg(F.count("*").alias("keys"))
    m = F.ceil(F.col("keys") / F.greatest(F.lit(float(cell_size)), F.sqrt("keys"))).cast("int")
    size = size.select("group", m.alias("m"), F.ceil(F.col("keys") / SALT_ROWS).cast("int").alias("parts"))
    short, long = (keys.where(c) for c in (f"length(key) <= {LONGEST_MEASURED}", f"length(key) >= {LONGEST_MEASURED}"))
    share = F.pmod(F.xxhash64("key"), F.col("m"))
    drawn = short.join(size, "group").groupBy("group", "m", "parts", share.alias("share")).agg(F.max_by("key", F.struct("n", "key")).alias("pivot"))
    pivots = drawn.groupBy("group", "parts").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))  # as many as the root of the keys
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine = short.join(size.select("group", "parts"), "group").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
    measured = mine.join(salted.select("group", "salt", "pivots"), ["group", "salt"]).select("group", "key", "parts", "pivots").mapInArrow(_place, PLACED)
    length = F.length("key")
    ring = F.when(length == LONGEST_MEASURED, F.array(length + 1)).otherwise(F.array(length, length - 1, length + 1))
    long = long.join(size.select("group", "parts"), "group").withColumn("ring", F.explode(ring)).where(f"ring > {LONGEST_MEASURED}")
    return measured.unionByName(long.select("group", "key", "parts", F.concat(F.lit("length "), "ring").alias("cell"), (F.col("ring") == length).alias("own"), length.alias("d")))


def radius_join(keys: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """Pairs ``group, a, b`` (a < b) of the distinct ``group, key`` within one edit or swap of neighbours. Null keys have no partner.

    Keys meet in the cells of ``cells``: those at home in a cell, with all that are in it. Keys whose distances from the pivot differ by
    more than 1 can't be partners, again by the triangle inequality; the others are compared by their distance.
    The comparisons of a large group are spread over ``parts`` tasks a cell.
    """
    counted = keys.select("group", "key").where("group is not null and key is not null").groupBy("group", "key").agg(F.count("*").alias("n"))
    with Scratch(keys.sparkSession) as scratch:
        placed = scratch.keep(cells(scratch.keep(counted, "keys"), cell_size), "cells")
        x = placed.where("own").select("group", "cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("a"), F.col("d").alias("da"))
        y = placed.select("group", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("b"), F.col("d").alias("db"), F.col("own").alias("at_home"))
        # A pair with one home is met twice there; once is enough.
        met = x.join(y, ["group", "cell", "part"]).where((F.abs(F.col("da") - F.col("db")) <= 1) & (F.abs(F.length("a") - F.length("b")) <= 1) & ((F.col("a") < F.col("b")) | (~F.col("at_home") & (F.col("a") > F.col("b")))))
        near = met.where(within_one_edit(F.col("a"), F.col("b"))).select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return written(near, "near-keys")


def _word_fits(a: Column, b: Column) -> Column:
    """Two words of organisations: equal, one edit apart, or one short for the other."""
    by_edit = (F.length(a.word) >= 4) & (F.length(b.word) >= 4) & (F.levenshtein(a.word, b.word) <= 2) & within_one_edit(a.word, b.word)
    short = ((a.short != "") & F.rlike(b.word, a.short)) | ((b.short != "") & F.rlike(a.word, b.short))
    return (a.word == b.word) | by_edit | short


def _both_ways(near: DataFrame) -> DataFrame:
    return near.unionByName(near.select("group", F.col("b").alias("a"), F.col("a").alias("b")))


def _person_links(forms: DataFrame, near: DataFrame) -> DataFrame:
    """Links ``p, q`` of full readings of persons: each hangs on a node for (group, key, given name) it may have, and such nodes are
    linked if their keys are near and their given names equal, or unknown and near. A common surname thus has as many links as readings, not pairs."""
    hub = lambda key, name: F.concat_ws("|", F.lit("h:"), "group", key, name)
    hung = forms.select("form", "group", "key", F.explode("names").alias("name"))
    hubs = hung.select("group", "key", "name").distinct()
    by_key = hubs.join(near.select("group", F.col("a").alias("key"), F.col("b").alias("key_2")), ["group", "key"]).unionByName(hubs.withColumn("key_2", F.col("key")))
    strange = near.select("group", F.col("a").alias("name"), F.col("b").alias("name_2")).where(F.startswith("name", F.lit("?")) & F.startswith("name_2", F.lit("?")))
    by_both = by_key.join(strange, ["group", "name"]).unionByName(by_key.withColumn("name_2", F.col("name"))).where("key <> key_2 or name <> name_2")
    known = hubs.select("group", F.col("key").alias("key_2"), F.col("name").alias("name_2"))
    across = by_both.join(known, ["group", "key_2", "name_2"], "left_semi").select(hub("key", "name").alias("p"), hub("key_2", "name_2").alias("q"))
    return hung.select(F.col("form").alias("p"), hub("key", "name").alias("q")).unionByName(across)


def _organisation_links(forms: DataFrame, near: DataFrame) -> DataFrame:
    """Links ``p, q`` of full readings of organisations with near keys, as many other words, each fitting one of the other's, and
    legal forms that don't differ. So that a common word as key doesn't join all its readings, a reading also meets by its rarest other word:
    by the word and those near to it, or by the first letter where either word is shortened."""
    x = forms.select("form", "group", "key", F.size("rest").alias("others"), "rest", "legal")
    words = x.where("others > 0").select("form", "group", F.explode("rest").alias("w"))
    rare = words.groupBy("group", F.col("w.word").alias("word")).agg(F.count("*").alias("n"))
    vague = (F.col("w.short") != "") | (F.length("w.word") < 4)
    chosen = words.withColumn("word", F.col("w.word")).join(rare, ["group", "word"]).groupBy("form").agg(F.min_by("w", F.struct(vague, "n", "w")).alias("w"))
    signed = lambda kind, c: F.concat(F.lit(kind), c)
    first = F.substring("w.word", 1, 1)
    one = x.where("others > 0").join(chosen, "form")
    by_word = one.join(near.select("group", F.col("a").alias("_a"), F.col("b").alias("_b")).withColumnRenamed("group", "_group"), (F.col("group") == F.col("_group")) & (F.col("w.word") == F.col("_a"))).select(*x.columns, signed("w:", F.col("_b")).alias("sign"))
    itself = one.select(*x.columns, F.explode(F.array(signed("w:", F.col("w.word")), F.when(F.col("w.short") == "", signed("s:", first)).otherwise(signed("f:", first)))).alias("sign"))
    alone = x.where("others = 0").withColumn("sign", F.lit(""))
    left = by_word.unionByName(itself).unionByName(alone)
    left = left.join(near.select("group", F.col("a").alias("key"), F.col("b").alias("key_2")), ["group", "key"]).unionByName(left.withColumn("key_2", F.col("key")))
    signs = F.flatten(F.transform("rest", lambda w: F.array_compact(F.array(signed("w:", w.word), signed("f:", F.substring(w.word, 1, 1)), F.when(w.short != "", signed("s:", F.substring(w.word, 1, 1)))))))
    right = x.select(F.col("form").alias("y_form"), "group", F.col("key").alias("key_2"), "others", F.col("rest").alias("y_rest"), F.col("legal").alias("y_legal"), F.explode(F.when(F.col("others") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(signs))).alias("sign"))
    met = left.join(right, ["group", "key_2", "others", "sign"]).where("form <> y_form")
    fits = lambda p, q: F.forall(p, lambda u: F.exists(q, lambda v: _word_fits(u, v)))
    legal = (F.col("legal") == "") | (F.col("y_legal") == "") | (F.col("legal") == F.col("y_legal"))
    return met.where(legal & fits("rest", F.col("y_rest")) & fits("y_rest", F.col("rest"))).select(F.col("form").alias("p"), F.col("y_form").alias("q"))


def link_entities(entities: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """``entity_id, group_id``: entities of one sample and type that are the same person or organisation
    share a group, named by its smallest entity.

    Spellings are read into a key (surname, or a word of the organisation's name) and the rest. Keys, other words and unknown given
    names are linked by ``radius_join`` within the sample. Two full readings of persons are the same if their
    keys are near and their given names may be (short forms and typing errors count); of organisations, if the other words fit and the legal forms don't
    differ. An entity spelled only with an initial, or as an acronym, joins the only group of its sample
    that it fits; if there are several, none.
    """
    with Scratch(entities.sparkSession) as scratch:
        found = readings(entities).withColumn("group", F.concat_ws("|", "entity_type", "sample_id"))
        form = F.xxhash64("group", "kind", "key", F.array_join("names", "|"), F.array_join("firsts", "|"), F.to_json("rest"), "legal")
        found = scratch.keep(found.withColumn("form", F.concat(F.lit("f:"), F.hex(form))), "readings")
        # The same reading in many entities is one node; the entities hang on it.
        forms = scratch.keep(found.where("kind <> 'acronym'").dropDuplicates(["form"]).select("form", "group", "entity_type", "kind", "key", "names", "rest", "legal"), "forms")
        words = F.concat(F.array("key"), F.filter("names", lambda n: F.startswith(n, F.lit("?"))), F.transform(F.filter("rest", lambda w: F.length(w.word) >= 4), lambda w: w.word))
        near_once = radius_join(forms.select("group", F.explode(words).alias("key")), cell_size)
        near = _both_ways(near_once)
        full_forms = forms.where("kind = 'full'")
        strong = _person_links(full_forms.where("entity_type = 'Person'"), near).unionByName(_organisation_links(full_forms.where("entity_type = 'Organization'"), near))
        own = found.where("kind = 'full'").select(F.concat(F.lit("e:"), "entity_id").alias("p"), F.col("form").alias("q"))
        nodes = connected_components(own.unionByName(strong), "p", "q").where(~F.startswith("node", F.lit("h:")))

        # Entities with nothing but initials or acronyms.
        weak = scratch.keep(found.join(found.where("kind = 'full'").select("entity_id").distinct(), "entity_id", "left_anti").select("entity_id", "kind", "form", "group", "key", "firsts"), "weak-names")
        full = scratch.keep(found.where("kind = 'full'").select("form", "group", "key", "firsts").distinct().join(nodes.withColumnRenamed("node", "form"), "form").select("group", "key", F.explode("firsts").alias("first"), "component").distinct(), "full-names")
        initial = weak.where("kind = 'initial'").select("entity_id", "form", "group", "key", F.get("firsts", F.lit(0)).alias("first"))
        # Whether one component fits or several: the smallest and the largest say.
        fit = (F.min("component").alias("low"), F.max("component").alias("high"))
        asked = initial.select("group", "key", "first").distinct()
        spelled = asked.join(near.select("group", F.col("a").alias("key"), F.col("b").alias("key_2")), ["group", "key"]).unionByName(asked.withColumn("key_2", F.col("key")))
        at_key = spelled.join(full.select("group", F.col("key").alias("key_2"), "first", "component"), ["group", "key_2", "first"]).groupBy("group", "key", "first").agg(*fit)
        fitted = scratch.keep(initial.join(at_key, ["group", "key", "first"], "left").select("entity_id", "form", "low", "high"), "initials")
        sorted_letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
        letters = full.where(F.startswith("group", F.lit("Organization"))).groupBy("group", sorted_letters(F.col("first")).alias("letters")).agg(*fit)
        acronym = weak.where("kind = 'acronym'").select("entity_id", "group", sorted_letters(F.col("key")).alias("letters"))
        fitting = fitted.where("low is not null").select("entity_id", "low", "high").unionByName(acronym.join(letters, ["group", "letters"]).select("entity_id", "low", "high"))
        only = fitting.groupBy("entity_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select(F.concat(F.lit("e:"), "entity_id").alias("node"), F.col("low").alias("component"))
        # Initials of one surname that fit no full name are one person.
        alone = fitted.where("low is null").select(F.concat(F.lit("e:"), "entity_id").alias("node"), F.col("form").alias("component"))
        every = nodes.where(F.startswith("node", F.lit("e:"))).unionByName(only).unionByName(alone)
        member = scratch.keep(every.groupBy("node").agg(F.min("component").alias("component")), "members")
        named = member.groupBy("component").agg(F.min("node").alias("group_node"))
        return written(member.join(named, "component").select(F.expr("substring(node, 3)").alias("entity_id"), F.expr("substring(group_node, 3)").alias("group_id")), "entities")


def same_pairs(entities: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """All pairs ``entity_id_a < entity_id_b`` of a group. A large group's pairs are made in as many tasks as it has ``SALT_ROWS`` members."""
    member = link_entities(entities, cell_size)
    parts = member.groupBy("group_id").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts")).where("parts > 1")
    spread = member.join(parts, "group_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = spread.select(F.col("entity_id").alias("entity_id_a"), "group_id", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int").alias("part"))
    y = spread.select(F.col("entity_id").alias("entity_id_b"), "group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return x.join(y, ["group_id", "part"]).where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
