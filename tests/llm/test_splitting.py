from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.splitting import _BLANK, _SENTENCE, _SPACE, LEVELS, PIECES, WS, split_oversized, split_spans

text = st.text(alphabet="ab .!?\n\r\té字", max_size=400)


def cut_level(text, limit):
    """The coarsest level at which every unit of ``text`` has at most ``limit`` code points, by its definition."""
    units = [text]
    for level, rx in zip(LEVELS, (_BLANK, _SENTENCE, _SPACE)):
        units = [u for t in units for u in rx.split(t)]
        if all(len(u.strip(WS)) <= limit for u in units):
            return level
    return LEVELS[3]


@settings(max_examples=600, deadline=None)
@given(text, st.integers(5, 60), st.integers(0, 4))
def test_pieces_tile_the_text_within_the_limit(t, limit, overlap):
    level, spans = split_spans(t, limit, overlap)
    assert all(b - s <= limit and 0 <= a - s <= overlap for s, a, b in spans)
    if len(t) > limit:
        assert level == cut_level(t, limit)
        assert all(b > a for _, a, b in spans)
        edges = [0, *(x for _, a, b in spans for x in (a, b)), len(t)]
        assert edges == sorted(edges)
        if t.strip(WS):
            assert not "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])).strip(WS)
    else:
        assert spans == [(0, 0, len(t))]


def test_a_blank_line_far_from_the_middle():
    t = "a " * 210 + "\n\n" + "b " * 854
    level, spans = split_spans(t, 2000, 200)
    assert level == "paragraph" and [a for _, a, _ in spans] == [0, 422]
    assert split_spans("x " * 700 + "\n\n" + "y" * 1950, 2000, 200) == ("paragraph", [(0, 0, 1402), (1352, 1402, 3352)])
    assert split_spans(" " * 5000, 2000, 200) == ("paragraph", [(0, 0, 2000)])


def test_cut_prefers_the_strongest_boundary():
    t = "a" * 30 + ". " + "b" * 28 + "\n\n" + "c" * 40
    _, spans = split_spans(t, 70, 0)
    assert [t[a:b] for _, a, b in spans] == [t[:62], t[62:]]


def test_levels():
    assert cut_level("x" * 5 + "\r\n \r\n" + "y" * 5, 5) == "paragraph"
    assert cut_level("xxxx. yyyyy", 5) == "sentence"
    assert cut_level("xxxxx yyyyy", 5) == "word"
    assert cut_level("xxxxxx yyyyy", 5) == "forced"
    assert cut_level("xxxxx\r\nyyyyy", 5) == "word"


def test_frame_cases(spark):
    rows = [("a", "w " * 1500, 1), ("a", "w " * 1500, 2), ("b", None, 1), ("c", "", 1), ("d", "x" * 2000, 1), (None, "y" * 200_000, 1)]
    df = spark.createDataFrame(rows, "id string, text string, piece_no int")
    out = split_oversized(df, "id", "text").collect()
    assert {r.id for r in out} == {"a", None}
    assert len([r for r in out if r.id == "a"]) == [r for r in out if r.id == "a"][0].n_pieces
    assert all(len(r.piece) <= 2000 for r in out)
    long = sorted((r for r in out if r.id is None), key=lambda r: r.piece_no)
    assert "".join(r.piece[r.overlap :] for r in long) == "y" * 200_000
    assert split_oversized(df.where("false"), "id", "text").schema == PIECES
    assert split_oversized(df.where("false"), "id", "text").count() == 0


def test_pieces_in_reading_order(spark):
    rows = [("p", "g", 2, "a " * 1500), ("q", "f", 10, "b " * 1500), ("r", "f", 9, "c " * 1500), ("r", "f", 9, "d " * 1500), ("r", "f", 9, "d " * 1500), ("s", "f", None, "e " * 1500), (None, None, 1, "f " * 1500)]
    df = spark.createDataFrame(rows, "id string, source_file string, page_ordinal int, text string").repartition(4)
    out = split_oversized(df, "id", "text", file_col="source_file", ordinal_col="page_ordinal").collect()
    places = list(dict.fromkeys((r.source_file, r.page_ordinal, r.id) for r in out))
    assert places == [("f", 9, "r"), ("f", 10, "q"), ("f", None, "s"), ("g", 2, "p"), (None, 1, None)]
    texts = {}
    for r in out:
        texts.setdefault((r.id, r.text_key), []).append(r)
    assert len(texts) == 6
    assert all([r.piece_no for r in rs] == list(range(1, rs[0].n_pieces + 1)) for rs in texts.values())
    assert {"".join(r.piece[r.overlap :] for r in rs) for rs in texts.values()} == {r[3] for r in rows}
