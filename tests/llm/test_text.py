import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import _text

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né \U0001f600", max_size=30)), max_size=8)


@given(TEXT)
def test_words_are_those_of_split(texts):
    got = []
    for lo, hi, data, off in _text.blocks(pa.array(texts, pa.string())):
        w = _text.words(data, off)
        for i in range(hi - lo):
            got.append([data[s:e].tobytes() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])])
    assert got == [(t or "").encode().split() for t in texts]


@given(TEXT, st.integers(1, 4))
def test_equal_runs_have_equal_hashes(texts, k):
    seen, back = {}, {}
    for lo, hi, data, off in _text.blocks(pa.array(texts, pa.string())):
        w = _text.words(data, off, fold=True)
        g = _text.grams(w.hashes, k)
        for i in range(hi - lo):
            ws = [data[s:e].tobytes().lower() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            for j in range(len(ws) - k + 1):
                run, h = tuple(ws[j : j + k]), int(g[w.first[i] + j])
                assert seen.setdefault(run, h) == h and back.setdefault(h, run) == run


def test_long_text_and_long_word():
    text = "ab " * 200_000 + "z" * 600_000 + " end"
    (lo, hi, data, off), = _text.blocks(pa.array([text]))
    w = _text.words(data, off)
    assert len(w.hashes) == 200_002 and len(np.unique(w.hashes)) == 3
    assert (w.ends - w.starts)[200_000] == 600_000


def test_sliced_and_null_columns():
    column = pa.array(["x y", None, "z", ""]).slice(1)
    (lo, hi, data, off), = _text.blocks(column)
    assert np.diff(_text.words(data, off).first).tolist() == [0, 1, 0]
