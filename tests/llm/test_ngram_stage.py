"""The pipeline's join stage against brute force over five-word sets and a similarity of 0.8."""

from quillspark.llm import ngram_join as J

from .helpers import frame, prose
from .test_ngram_join import cases, near, sets


def kept(texts):
    s, root = sets(texts, 5), list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(s)):
            for b in range(a):
                x, y, m = s[a], s[b], min(root[a], root[b])
                if x and y and root[a] != root[b] and 10 * len(x & y) >= 8 * len(x | y):
                    root[a] = root[b] = m
                    changed = True
    return [i for i, r in enumerate(root) if i == r]


def test_stage_takes_five_words(spark):
    base = prose(31, 200, 5000)
    texts = cases() + [base, near(base, 1, 4)]
    three, five = (sets(texts[-2:], n) for n in (3, 5))
    share = lambda p: len(p[0] & p[1]) / len(p[0] | p[1])
    assert share(three) < 0.9 and share(five) >= 0.8
    want = kept(texts)
    assert len(texts) - 2 in want and len(texts) - 1 not in want
    assert sorted(r.doc_id for r in J.ngram_join_stage(spark, frame(spark, texts), "").collect()) == want
