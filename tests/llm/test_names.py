import random

import pytest

from palimpsest.llm.names import cells, edit_distances, link_entities, one_edit, radius_join, same_pairs

SCHEMA = "entity_id string, sample_id string, name string, entity_type string, aliases array<string>, key string, group string"


def entities(spark, rows):
    return spark.createDataFrame([(i, s, n, t, a, "clash", "clash") for i, s, n, t, a in rows], SCHEMA)


def by_search(a, most):
    """Strings within ``most`` edits of ``a`` over a small alphabet, with their distances."""
    found, front = {a: 0}, {a}
    for d in range(1, most + 1):
        front = {x for w in front for i in range(len(w) + 1) for x in [w[:i] + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], *(w[:i] + c + w[i:] for c in "ab"), *(w[:i] + c + w[i + 1 :] for c in "ab")]} - set(found)
        found |= dict.fromkeys(front, d)
    return found


def test_the_distance_is_that_of_the_fewest_edits():
    for a in ("", "ab", "aabb", "abab"):
        want = by_search(a, 3)
        words = [w for w in want if len(w) <= 5]
        assert edit_distances([a] * len(words), words).tolist() == [want[w] for w in words]
    assert edit_distances(["ca"], ["abc"]).tolist() == [2] and edit_distances([], []).tolist() == []


def near_keys(rng):
    keys = {("g", "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))) for _ in range(150)} | {("h", "solo"), ("h", "sola"), ("i", "lone")}
    for n in (63, 64, 65, 90):
        keys |= {("g", "ab" * 100)} | {("g", ("xyz" * 40)[:n]), ("g", ("xyz" * 40)[:n] + "q"), ("g", "q" + ("xyz" * 40)[1:n])}
    for g, k in list(keys):
        i = rng.randrange(len(k))
        keys.add((g, rng.choice([k[:i] + k[i + 1 :], k[:i] + "x" + k[i:], k[:i] + "x" + k[i + 1 :], k[:i] + k[i : i + 2][::-1] + k[i + 2 :]]) or "z"))
    return sorted(keys)


@pytest.mark.parametrize("cell_size", [1, 4, 16, 10_000])
def test_radius_join_against_all_pairs(spark, cell_size, monkeypatch):
    if cell_size == 4:
        monkeypatch.setattr("palimpsest.llm.names.SALT_ROWS", 40)
    keys = near_keys(random.Random(2))
    got = sorted(tuple(r) for r in radius_join(spark.createDataFrame([*keys, keys[0], ("g", None), (None, "x")], "group string, key string"), cell_size).collect())
    assert got == [(g, a, b) for g, a in keys for h, b in keys if g == h and a < b and one_edit(a, b)]


def test_every_group_has_pivots(spark):
    keys = spark.createDataFrame([(g, k, 1) for g, k in near_keys(random.Random(2))], "group string, key string, n bigint")
    rows = [r for r in cells(keys, 8).collect() if not r.cell.startswith("length")]
    homes = [(r.group, r.key) for r in rows if r.own]
    assert len(homes) == len(set(homes)) and {g for g, _ in homes} == {"g", "h", "i"}
    assert len({r.cell for r in rows if r.group == "g"}) > 8 and all(r.cell and r.d >= 0 for r in rows)


def groups(df):
    out = {}
    for r in link_entities(df).collect():
        out.setdefault(r.group_id, set()).add(r.entity_id)
    return sorted(map(sorted, out.values()))


def test_persons(spark):
    rows = [
        ("1", "s", "Robert Kavdonlik", "Person", None), ("2", "s", "Kavdonlik, Bob", "Person", []), ("3", "s", "ROBERT KAVDONLIK", "Person", [None, ""]), ("4", "s", "Róbert Kavdonlík", "Person", None), ("5", "s", "Dr. Robert J. Kav-Donlik", "Person", None),
        ("6", "s", "Kavdonlik Roburt", "Person", None), ("7", "s", "R. Kavdonlik", "Person", None), ("8", "s", "@rkavdonlik", "Person", None), ("9", "s", "RobertKavdonlik", "Person", None), ("10", "s", "robert.kavdonlki", "Person", None),
        ("11", "s", "R.K.", "Person", ["Bobby Kavdonlik"]), ("20", "s", "Thomas Kavdonlik", "Person", None), ("21", "s", "T. Kavdonlik", "Person", ["Tom Kavdonlik"]), ("30", "t", "Robert Kavdonlik", "Person", None), ("40", "s", "Robert Kavdonlik", "Location", None),
        ("1", "s", "Robert Kavdonlik", "Person", None), (None, "s", "Robert Kavdonlik", "Person", None), ("50", None, "Robert Kavdonlik", "Person", None), ("60", "s", None, "Person", None),
    ]
    assert groups(entities(spark, rows)) == sorted([sorted(["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11"]), ["20", "21"], ["30"]])


def test_an_initial_that_fits_two_joins_none(spark):
    rows = [("1", "s", "Robert Kavdonlik", "Person", None), ("2", "s", "Richard Kavdonlik", "Person", None), ("3", "s", "R. Kavdonlik", "Person", None)]
    assert groups(entities(spark, rows)) == [["1"], ["2"]]


def test_organisations(spark):
    rows = [
        ("1", "s", "Kavdon Timber Limited", "Organization", None), ("2", "s", "The Kavdon Timber Ltd", "Organization", None), ("3", "s", "Kavdon & Co. Timber", "Organization", None), ("4", "s", "Timber Kavdon (Limited)", "Organization", None), ("5", "s", "KAVDON TIMBER", "Organization", None),
        ("6", "s", "Kavdon Timb. Ltd", "Organization", None), ("7", "s", "KTL", "Organization", None), ("8", "s", "Kavdno Timber", "Organization", None), ("9", "s", "Kavdon Optics Limited", "Organization", None), ("10", "s", "Kavdon Timber Foundation", "Organization", None),
    ]
    assert groups(entities(spark, rows[:9])) == sorted([sorted(map(str, range(1, 9))), ["9"]])
    assert {tuple(r) for r in same_pairs(entities(spark, [rows[0], rows[1], rows[9]])).collect()} == {("1", "2")}


def test_common_surnames_and_words(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.llm.names.SALT_ROWS", 3)
    rows = [(f"a{i}", "s", f"{n} Zborowik", "Person", None) for i, n in enumerate(["Quenna", "Quena", "Thorvik", "Peter", "Pete", "Thorvick", "Xandu"])]
    rows += [(f"o{i}", "s", n, "Organization", None) for i, n in enumerate(["National Marble Works", "Nationl Marble Wrks", "National Tulip Works", "Natl. Marble Works", "National Marb. Works", "National", "Natoinal"])]
    rows += [("long", "s", "Anna " + "verylong" * 50, "Person", ["", "x" * 5000])]
    assert groups(entities(spark, rows)) == sorted([["a0", "a1"], ["a2", "a5"], ["a3", "a4"], ["a6"], ["o0", "o1", "o3", "o4"], ["o2"], ["o5", "o6"], ["long"]])
    assert {tuple(r) for r in same_pairs(entities(spark, [(f"e{i}", "s", "Bob Zborowik", "Person", None) for i in range(7)])).collect()} == {(f"e{i}", f"e{j}") for i in range(7) for j in range(i + 1, 7)}


def test_empty(spark):
    assert same_pairs(entities(spark, [])).count() == 0
