"""Word diffs, applying them, similarity and alignment: examples and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import diff

EXAMPLES = [
    ("a b c", "a X c", [(1, 2, "b", "X")]),
    ("a b", "a b c", [(2, 2, "", "c")]),
    ("a b c", "a c", [(1, 2, "b", "")]),
    ("a b", "a b", []),
    ("a b c", "a X\nY c", [(1, 2, "b", "X\nY")]),
]


def changes(base, suggested):
    return [(c["start"], c["end"], c["original"], c["replacement"]) for c in diff.word_changes(base, suggested)]


def test_changes():
    for base, suggested, expected in EXAMPLES:
        assert changes(base, suggested) == expected


def c(start, end, replacement):
    return {"start": start, "end": end, "replacement": replacement}


def test_apply():
    assert diff.with_changes("a b c d", [c(1, 2, "X"), c(3, 4, "Y Z")]) == "a X c Y Z"
    assert diff.with_changes("a b c", [c(0, 2, "P"), c(1, 3, "Q")]) == "a Q"
    assert diff.with_changes("a c", [c(1, 1, "b")]) == "a b c"
    assert diff.with_changes("line one\nline two word3", [c(4, 5, "changed")]) == "line one\nline two changed"
    assert diff.with_changes("one\ntwo three\nfour", [c(1, 2, "TWO"), c(3, 4, "FOUR")]) == "one\nTWO three\nFOUR"
    assert diff.with_changes("a b", [c(2, 2, "c")]) == "a b c"
    assert diff.with_changes("", [c(0, 0, "x")]) == "x"
    assert diff.with_changes("a b", [c(1, 2, "")]) == "a "


TEXT = st.lists(st.sampled_from("abcdx"), max_size=12).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_applying_a_diff_gives_the_suggested_words(base, suggested):
    assert diff.with_changes(base, diff.word_changes(base, suggested)).split() == suggested.split()


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_alignment_is_a_longest_common_subsequence(a, b):
    x, y = a.split(), b.split()
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
    pairs = diff.anchors(x, y)
    assert len(pairs) == table[-1][-1]
    assert all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs)


def test_similarity_ignores_popular_words_only_in_ratio():
    tail = " ".join(["w"] * 250)
    assert diff.ratio("x " + tail, "y " + tail) == 0.0  # a popular word starts no match there
    assert diff.word_changes("x " + tail, "y " + tail) == [{"start": 0, "end": 1, "original": "x", "replacement": "y"}]


def test_score_and_projection():
    assert diff.alignment_score("", "") == 100
    assert diff.alignment_score("a b c", "a b") == 80
    assert diff.projection("a b c d", "a X c d", 1, 2) == "X"
    assert diff.projection("a b", "", 0, 1) is None


def test_zlib_share():
    assert diff.zlib_share("la " * 100) < 0.28 < diff.zlib_share("".join(map(chr, range(33, 120))))
    assert diff.zlib_share("") is None
