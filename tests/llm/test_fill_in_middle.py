"""Fill-in-the-middle against plain code."""

import hashlib
import re

from threadloom.llm import fill_in_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    t = TOKEN.findall(text)
    n = len(t)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (t[:low], t[low:high], t[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text))


STRANGE = [
    None, "", " ", "\n\t ", "a", " a ", "a  b\n\nc ", "x\x1fy \x1ez\x1e\x1f \x1fd\x1ee", "\x1ed \x1ee \x1e\x1e \x1f\x1f", "<P> in it", "ends <S>", "<M>",
    "<", "<P", "a<S", "<S <M", "P> S> M>", "naïve é b c", "a😀b 😀😀 c", "a\x1cb\x85c\x0bd\x0ce", "$0 $1 \\d \\$ \\", "x" * 50_000, "a😀" * 40_000, "w " * 40_000, " " * 40_000, "é\x1f" * 20_000,
]


def test_every_form_against_plain_code(spark):
    rows = [(100 * k + i, t) for k in range(12) for i, t in enumerate(STRANGE)] + [(None, "no id here"), (7, "twice told"), (7, "twice told")]
    docs = spark.createDataFrame([(*r, "other", "again") for r in rows], "doc_id long, text string, marked string, output string")
    got = sorted(map(tuple, M.report(docs).collect()), key=repr)
    want = sorted((brute(*r) for r in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_parts_are_the_text(spark):
    docs = spark.createDataFrame([(i, f"one two{i} three\x1f\nfour  five ") for i in range(60)], "doc_id long, text string")
    for r in M.transform(docs, percent=100, spm_percent=50).collect():
        assert r.text.startswith(r.prefix + r.middle) and len(r.output) == len(r.text) + 9 and r.form in ("psm", "spm")


def test_empty_table(spark):
    assert M.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
