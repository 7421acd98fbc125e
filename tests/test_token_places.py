"""Words and their places: those of texts in Latin-1 are found as arrays, others one by one."""

import random

import pyarrow as pa
import regex

from folioscope.operators import chunks as C


def plain(texts, least):
    out = []
    for i, text in enumerate(texts):
        found = {}
        for m in regex.finditer(C.WORD, text or ""):
            found.setdefault(m.group(), []).append(m.start())
        out += [(i, w, p) for w, p in found.items() if len(w) >= least]
    return sorted(out)


def test_tokens_of_odd_texts():
    random.seed(5)
    odd = [None, "", "_ -", "a", " a b a ", "über straße ü", "x²ª³µº a­·b", "中文 é a 中文", "é ٣٤", "😀a😀a"]
    odd += ["".join(random.choices("ab_é\xffß²\x85\xa0 -.\n٣́😀", k=random.randint(0, 30))) for _ in range(600)]
    for texts in (odd, [None], ["", "-"], ["é" * 3000 + " é"], [t for t in odd if (t or "").isascii()] * 9):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1] * len(texts)), pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "page", "chunk_index", "text"])
        for least in (1, 2):
            got = [r for b in C._tokens_of(least)(iter([batch])) for r in b.to_pylist()]
            assert sorted((r["chunk_index"], r["token"], r["positions"]) for r in got) == plain(texts, least)
            assert all(r["doc_id"] == r["chunk_index"] and r["page"] == 1 for r in got)


def test_latin_texts_are_not_searched_word_by_word(monkeypatch):
    monkeypatch.setattr(C, "_other_tokens", lambda *a: 1 / 0)
    rows, tokens, places = C._latin_tokens(["Ünd ein und ein".lower().encode("latin-1"), b"", b"ein"], 1)
    assert sorted(zip(rows.tolist(), tokens.to_pylist(), places.to_pylist())) == [(0, "ein", [4, 12]), (0, "und", [8]), (0, "ünd", [0]), (2, "ein", [0])]
