from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import chunking as C


def test_vectors():
    assert C.chunk_text("") == [] and C.chunk_text("   \n\n  ") == [] and C.chunk_text(None) == []
    assert C.chunk_text("hello world", 800, 120) == ["hello world"]
    two = " ".join(["alpha"] * 100) + "\n\n" + " ".join(["beta"] * 100)
    for overlap in (120, 100_000):
        got = C.chunk_text(two, 800, overlap)
        assert len(got) >= 2 and all(len(c) <= 800 for c in got)
    got = C.chunk_text(two, 800, 120)
    assert got[1].startswith("alpha") and "beta" in got[1]
    long = C.chunk_text("word " * 500, 200, 50)
    assert len(long) > 3 and long[1][:40] in long[0]
    assert C.overlap_tail("alpha beta gamma delta", 8) == "delta" and C.overlap_tail("alpha beta gamma delta", 0) == "" and C.overlap_tail("tiny", 10) == "tiny"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=600), st.integers(50, 120), st.integers(0, 60))
def test_chunks_are_bounded_and_cover(text, size, overlap):
    got = C.chunk_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in got)
    assert bool(got) == bool(text.strip())
    letters = [ch for ch in text if ch in "ab"]
    assert sum(ch in "ab" for c in got for ch in c) >= len(letters)


def test_other_cutters():
    assert C.heading_sections("intro\n# A\ntext\n## B\nmore") == ["intro", "# A\ntext", "## B\nmore"]
    assert C.bounded_lines("aa\nbb\ncc\n", 6) == ["aa\nbb\n", "cc\n"]
    text = " ".join(f"Sentence number {i}." for i in range(300))
    w = C.sliding_windows(text, 400, 100)
    assert len(w) > 3 and all(len(x) <= 400 for x in w) and w[1].split(".")[0] in w[0]
    assert len(C.keep_ends(text, 500)) < 520 and C.keep_ends("short", 10) == "short"
