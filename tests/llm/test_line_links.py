import random

import pytest

from skein.llm.line_dedup import line_dedup, similar


def brute_links(rows, threshold=0.8):
    """Per document: (line, class id, class line, similar sets) of lines that are not alone."""
    lines = sorted((i, k, frozenset(x.encode().lower().split())) for i, t in rows for k, x in enumerate(t.split("\n")))
    lines = [x for x in lines if x[2]]
    sets = list(dict.fromkeys(x[2] for x in lines))
    partners = {a: [b for b in sets if a != b and similar(a, b, threshold)] for a in sets}
    first = {s: next(x[:2] for x in lines if x[2] == s) for s in sets}
    found = {i: [] for i, _ in rows}
    for i, k, s in lines:
        group, work = {s}, [s]
        while work:
            new = set(partners[work.pop()]) - group
            group |= new
            work += new
        if partners[s] or sum(x[2] == s for x in lines) > 1:
            found[i].append((k, *min(first[x] for x in group), len(partners[s])))
    return found


@pytest.mark.parametrize("hot, chunk", [(4_096, 2_048), (3, 5), (20, 60)])
def test_all_links_are_found(spark, hot, chunk):
    rng = random.Random(5)
    base = [["w%d" % rng.randrange(400) for _ in range(rng.choice([8, 20, 40]))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(4)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = "v%d" % rng.randrange(400)
            lines.append(" ".join(line))
        rows.append((i, "\n".join([*lines, "a common line here", f"alone{i} x{i}"])))
    near = ["n%d" % k for k in range(40)]
    rows += [(100 + i, " ".join([*near[:i % 40], "z%d" % i, *near[i % 40 + 1:]])) for i in range(120)]
    got = {r.doc_id: [tuple(x) for x in r.links] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counters=1 << 12, hot=hot, chunk=chunk).collect()}
    want = brute_links(rows)
    assert max(x[3] for found in want.values() for x in found) > 8
    assert got == want
