import re

import numpy as np
import pytest

from framewright.llm import op7_url_trust as m

# Steps after which nothing that could be seen is still on its way.
ITERATIONS = 200

SCHEMA = "page_id bigint, url string, html string, host string, value string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def link(*hosts):
    return "".join(f'<a class=x href="//{h}/p">t</a>' for h in hosts)


def brute(rows):
    """Hosts, rules, and the three ranks by plain iteration over dictionaries."""
    judged = []
    for i, u, h in rows:
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [r for r in m.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        judged.append((i, host, path, rule, [x.lower() for x in re.findall(r'href="//([^/"]*)', h or "")]))
    links = {}
    for _, host, _, _, out in judged:
        for o in out:
            if host and o and o != host:
                links[host, o] = links.get((host, o), 0) + 1
    hosts = {j[1] for j in judged} | {b for _, b in links}
    ranks = {}
    for name, verdict, turned in (("trust", "allow", False), ("rank", None, False), ("distrust", "block", True)):
        mass = {h: sum(1 for j in judged if j[1] == h and (verdict is None or (j[3] and j[3][0] == verdict))) for h in hosts}
        total = max(sum(mass.values()), 1)
        edges = {(b, a) if turned else (a, b): n for (a, b), n in links.items()}
        out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
        r = {h: mass[h] / total for h in hosts}
        for _ in range(ITERATIONS):
            new = {h: (1 - m.DAMPING) * mass[h] / total for h in hosts}
            for (a, b), n in edges.items():
                new[b] += m.DAMPING * r[a] * n / out[a]
            for h in hosts:
                if not out[h]:
                    new[h] += m.DAMPING * r[h]
            r = new
        ranks[name] = r
    rows_out = []
    for i, host, path, rule, _ in judged:
        total = sum(ranks[n][host] for n in ranks)
        share = ranks["distrust"][host] / total if total else 0
        verdict = rule[0] if rule else "block" if share > m.THRESHOLD else "allow"
        rows_out.append((i, host, path, rule[1] + rule[2] if rule else None, verdict, round(share, 9)))
    return sorted(rows_out, key=str)


ROWS = [
    (1, "http://a.net/x", link("farm.example.org", "a.net")),
    (2, "https://WWW.Example.NET/en/1?q#f", link("good.example.org")),
    (3, "http://example.com/de/2", ""),
    (4, "http://example.com/en/2", link("b.example.org")),
    (5, "http://farm.example.org/a", link("a.net", "a.net", "example.com")),
    (6, "http://farm.example.org/fr/", link("a.net")),
    (7, "http://good.example.org/fr", None),
    (8, "http://b.example.org/en", "<a href='no'>"),
    (9, None, link("a.net")),
    (10, "no scheme", ""),
    (None, "http://x.net", ""),
    (11, "http://net/", ""),
    (12, "http://notexample.net?p=/en/", ""),
    (5, "http://farm.example.org/a", link("a.net", "a.net", "example.com")),
    (13, "http://ring.example.info/", link("a.net", "bad.net")),
    (14, "", None),
]


def found(spark, rows):
    got = m.judge(pages(spark, rows)).collect()
    return sorted(
        ((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.distrust_share, 9)) for r in got), key=str
    )


def test_against_plain_iteration(spark):
    assert found(spark, ROWS) == brute(ROWS)
    by = {r[0]: r for r in found(spark, ROWS)}
    assert by[13][4] == "block" and by[8][4] == "allow"


def test_empty_table(spark):
    assert m.judge(pages(spark, [])).collect() == []


def test_nothing_blocked_without_rules(spark):
    got = m.judge(pages(spark, ROWS), rules=()).collect()
    assert {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {None}


@pytest.mark.parametrize("steps", [3, m.STEPS])
def test_long_chain_and_ring_against_solved_system(spark, steps):
    """Twenty single links into a blocked seed, and a ring: ranks of the solved equations."""
    n = 26
    names = [f"h{i:02}.info" for i in range(n)]
    edges = [(i, i + 1, 1) for i in range(20)]
    edges += [(22, 23, 1), (23, 24, 2), (24, 22, 1), (24, 20, 1)] if steps == m.STEPS else []
    s = np.zeros((3, n))
    s[0, 21], s[1], s[2, 20] = 0.1, 0.001, 0.1
    seeds = spark.createDataFrame(
        [(names[i], *map(float, s[:, i])) for i in range(n)], "host string, s_trust double, s_rank double, s_distrust double"
    )
    links = spark.createDataFrame([(names[a], names[b], c) for a, b, c in edges], "src string, dst string, n bigint")
    got = {r.host: (r.trust, r.rank, r.distrust) for r in m.spread(seeds, links, steps=steps).collect()}
    for k in range(3):
        w = np.zeros((n, n))
        for a, b, c in edges:
            w[(b, a) if k == 2 else (a, b)] += c
        for i in range(n):
            w[i] = w[i] / w[i].sum() if w[i].any() else np.eye(n)[i]
        solved = np.linalg.solve(np.eye(n) - m.DAMPING * w.T, (1 - m.DAMPING) * s[k])
        assert np.allclose([got[h][k] for h in names], solved, rtol=1e-6, atol=1e-12)
    assert steps == m.STEPS or all(got[names[i]][2] > got[names[i]][0] + got[names[i]][1] for i in range(8))
