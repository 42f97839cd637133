"""Line rules against a plain loop, on odd rows; the SQL covers the whole query."""

import random
import re
from collections import Counter


from checks.compare import connect, difference
from prefspark.llm import line_quality as Q
from prefspark.llm.queries import SQL, op10_line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, max_docs, max_share, percent_left):
    lines = [
        [(" ".join(WORD.findall(l.lower())), len(WORD.findall(l)), l) for l in (t or "").split("\n") if WORD.search(l)]
        for _, t, _ in rows
    ]
    hosts, counts = Counter(h for *_, h in rows), Counter()
    for (_, _, host), own in zip(rows, lines):
        counts.update({(host, n) for n, *_ in own})
    result = []
    for (doc_id, text, host), own in zip(rows, lines):
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        gone = sum(
            n for line, n, _ in own
            if counts[host, line] > max_docs and counts[host, line] > max_share * hosts[host]
        )
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        left = len(words) - gone
        result.append((
            doc_id, len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text),
            len(own) - len({raw for *_, raw in own}), len(repeated), failed,
            not failed and 100 * left >= percent_left * len(words), left,
        ))
    return result


def test_against_a_plain_loop(docs):
    random.seed(2)
    vocabulary = ["Alpha", "beta", "#g", "é<", "x|y"]
    line = lambda: " ".join(random.choices(vocabulary, k=random.randint(0, 9)))
    rows = [
        (i, "\n".join(line() for _ in range(random.randint(0, 30))), random.choice(["h1", "h2", None]))
        for i in range(60)
    ]
    unique = " ".join(f"w{i}" for i in range(60))
    rows += [(100 + i, "Shared  LINE here\t\n" + unique.replace("w", f"v{i}"), "h1") for i in range(9)]
    rows += [(200, None, "h1"), (200, None, "h1"), (None, "", None), (201, " \n\t\n \x0b", "h2"), (202, unique * 200, "h3")]
    table = docs([(d, t, "kept", h) for d, t, h in rows]).withColumnRenamed("lang", "kept")
    found = [tuple(r) for r in Q.quality(table, max_docs=4, max_share=0.1).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows, 4, 0.1, 30), key=repr)


def test_no_documents(docs):
    assert Q.quality(docs([])).count() == 0


def test_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(op10_line_quality(spark, sf_dir), connect(sf_dir), SQL["op10_line_quality"]) is None
