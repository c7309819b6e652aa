"""Fill-in-middle outputs against a plain statement of the contract."""

from __future__ import annotations

import hashlib
import re

import pytest

from sparkwell.llm import infilling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plainly(doc, text, seed=42):
    text = text or ""
    found = UNIT.findall(text)
    n = len(found)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc, n, "plain", None, None, sha(text), sha(text)), text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(found[:lo]), "".join(found[lo:hi]), "".join(found[hi:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc, n, form, len(p), len(m), sha(out), sha(text)), out


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
HARD = ["\x01", "\x02", "\x01d\x02e \x01e", "a\x02b c\x01 \x02", " \t\r\n\x0b\x0c", "a b c", "x <P> y", "< P><S", "<S", "P><M", "😀 é\n\nab  ", "$1 \\ $0", "a <M", "M> b <", "one", "\x85 \x1c x"]


def test_outputs(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    frame = odd.select("doc_id", "text", "n", odd["sha"].alias("form"), odd["node"].alias("prefix"))
    more = [(i, HARD[i % len(HARD)] * (1 + i % 3)) for i in range(200, 600)]
    frame = frame.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    outputs = infilling.fill_in_middle(frame)
    got = sorted(map(str, (tuple(r[c] for c in NAMES) for r in infilling.digests(outputs).collect())))
    want = [plainly(*r) for r in rows + more]
    assert got == sorted(str(w[0]) for w in want)
    assert sorted(str((r["doc_id"], r["output"])) for r in outputs.collect()) == sorted(str((w[0][0], w[1])) for w in want)
    assert {w[0][2] for w in want} == {"plain", "psm", "spm"}


def test_nothing_is_shuffled_or_run_in_python(odd):
    plan = infilling.digests(infilling.fill_in_middle(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_edges(spark, empty):
    assert infilling.fill_in_middle(empty).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P><S>", "<M>"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="markers"):
            infilling.fill_in_middle(empty, markers=bad)
    docs = spark.createDataFrame([(i, f"w{i} of  some words ") for i in range(50)], "doc_id long, text string")
    every = infilling.fill_in_middle(docs, seed=7, rate=100, spm_rate=0)
    assert {r["form"] for r in every.collect()} == {"psm"}
    assert all(r["prefix"] + r["middle"] + r["suffix"] == f"w{r['doc_id']} of  some words " for r in every.collect())
