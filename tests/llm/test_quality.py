import random
import re
from collections import Counter

import numpy as np

from catsim.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(i, text):
    t = text or ""
    w = WORD.findall(t)
    win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    rep = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, sym, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(rep) > 20 * n
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
    bad = 5 * sym > n or 2 * dup > len(lines) or chars < 2 * n or chars > 15 * n or 2 * letters < n or 20 * len(set(w)) < n
    return (i, n, chars, sym, dup, len(rep), failed, not failed and not bad)


def test_against_brute_force(spark):
    r = random.Random(7)
    vocab = ["a", "bb", "ccc", "né", "日本", "#", "|", "12", "w" * 40, "***", " "]
    rows = []
    for i in range(300):
        some = r.sample(vocab, r.randint(1, 8)) + [f"u{r.randint(0, 999)}" for _ in range(r.randint(0, 90))]
        rows.append((i, "".join(r.choice(some) + r.choice([" ", " ", "\n", "\t"]) for _ in range(r.randint(0, 80)))))
    rows += [(400, None), (401, ""), (402, " \n\n"), (0, rows[0][1]), (None, "x y"), (403, "ab cd " * 20000), (404, "same line here\n" * 30)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean").repartition(2)
    want = sorted((brute(i, t) for i, t in rows), key=str)
    assert 0 < sum(w[-1] for w in want) < sum(not w[-2] for w in want)
    for order in (None, list(quality.RULES), list(quality.RULES)[::-1]):
        assert sorted(map(tuple, quality.judge(df, order).collect()), key=str) == want


def test_report_and_empty(spark):
    df = spark.createDataFrame([(i, "one two three four five six seven eight nine ten ### ###") for i in range(50)], "doc_id long, text string")
    report = {r.rule: r for r in quality.rule_report(df).collect()}
    assert set(report) == set(quality.RULES) and report["symbols"].rejected == 50 and report["letters"].rejected == 0
    assert quality.rule_order(df)[0] == "symbols"
    assert quality.judge(df.limit(0)).collect() == []


def test_letters_of_some_rows_only():
    texts = [b"1 2 3 x", b"a b 1", b"", "1 é 日 2".encode(), b" 12 x1", b"1 2"]
    batch = quality.measure(texts)
    want = {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}
    for rows in ([0, 1, 2, 3, 4, 5], [5, 0], [2], [3, 5], []):
        assert quality.RULES["letters"](batch, np.array(rows, np.int64)).tolist() == [want[r] for r in rows]
