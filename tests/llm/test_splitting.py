from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.splitting import split_text, split_units


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n#!。，é🫖", max_size=400), st.integers(1, 40), st.integers(0, 45))
def test_pieces_cover_the_text(text, size, overlap):
    spans = split_text(text, size, overlap)
    kept = max(0, min(overlap, size - 1))
    assert bool(spans) == bool(text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= size for a, b in spans)
        for (_, e), (s, f) in zip(spans, spans[1:]):
            assert s == e - kept and f > e
        joined = text[: spans[0][1]] + "".join(text[e:f] for (_, e), (_, f) in zip(spans, spans[1:]))
        assert joined == text


def test_natural_boundaries_come_first():
    text = "One sentence here. Another one.\n\nA new paragraph begins. It ends."
    assert [text[a:b] for a, b in split_text(text, 40, 0)] == ["One sentence here. Another one.\n\n", "A new paragraph begins. It ends."]
    assert [text[a:b] for a, b in split_text(text, 20, 0)][0] == "One sentence here. "
    assert [b - a for a, b in split_text("x" * 25, 10, 2)] == [10, 10, 9]


def test_units(spark):
    samples = spark.createDataFrame([("s", "c"), ("t", "none"), (None, "c")], "sample_id string, config_id string")
    configs = spark.createDataFrame([("c", 10, 3), ("bad", 0, 1)], "config_id string, chunk_size int, chunk_overlap int")
    rows = [("a", "s", "0123456789", 1), ("b", "s", "0123456789a", 1), ("b", "s", "0123456789a", 2), ("c", "s", None, 1), ("d", "s", "", 1), ("e", "t", "x" * 99, 1), ("f", None, "x" * 99, 1), (None, "s", "x" * 99, 1), ("g", "s", "🫖" * 10, 1), ("h", "s", "word " * 40_000, 1)]
    units = spark.createDataFrame(rows, "uid string, sample_id string, text_content string, size int")
    got = split_units(units, samples, configs).collect()
    assert {r.uid for r in got} == {"b", "h"}
    assert [(r.piece_no, r.start, r.end, r.piece) for r in sorted((r for r in got if r.uid == "b"), key=lambda r: r.piece_no)] == [(1, 0, 10, "0123456789"), (2, 7, 11, "789a")]
    assert split_units(units.limit(0), samples, configs).count() == 0
