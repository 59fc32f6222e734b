import re
from collections import Counter

from tidemill.llm.quality_rules import judged, keep_clean, line_quality


def test_base_figures_by_brute_force(odd_docs, empty_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in line_quality(odd_docs).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(win)
        rep = len({i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert line_quality(empty_docs).count() == 0
    kept = keep_clean(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in line_quality(odd_docs).collect())


def test_line_rules():
    good = "\n".join(" ".join(f"w{i * 100 + k}" for k in range(12)) + " ends." for i in range(10))
    assert judged(good, 50)[6]
    nav = "\n".join(["Home | News | About | Contact"] * 30)
    junk = "\n".join(" ".join(f"SHOUT{i}X{k}!!" for k in range(9)) for i in range(30))
    assert judged(f"{good}\n{nav[:60]}", 50)[6]
    assert not judged(f"{good[:200]}\n{junk}", 50)[6]
    assert judged(f"{good}\nRead more about our cookie policy.", 50)[10] == good
    n, *_, lines, lost, _, clean = judged(f"{good}\n{nav}", 50)
    assert (lines, lost, clean) == (40, 30, good)
