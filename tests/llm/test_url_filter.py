"""URL filters: rules, and both walks against dense linear algebra."""

import random
import re

import numpy as np

from ingestkit.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, verdict string, trust int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def fitting(host, path):
    fits = [r for r in U.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def walk(hosts, links, seeds, rounds=300):
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts),) * 2)
    for (a, b), n in links.items():
        m[at[a], at[b]] += n
    total = m.sum(axis=1)
    s = np.array([seeds.get(h, 0) for h in hosts], float)
    score = s.copy()
    for _ in range(rounds):
        moved = (score / np.where(total > 0, total, 1)) @ m
        score = U.DAMPING * moved + s * ((1 - U.DAMPING * score[total > 0].sum() / s.sum()) if s.sum() else 0)
    return dict(zip(hosts, score))


def test_against_dense_walks(spark):
    rng = random.Random(4)
    names = [f"h{k}.{d}" for k, d in enumerate(["com", "net", "example.org", "net", "com", "org"] * 3)]
    rows, links = [], {}
    for k in range(150):
        host = rng.choice(names)
        to = [rng.choice(names) for _ in range(rng.randrange(4))]
        html = " ".join(f'<a class="x" HREF="{rng.choice(["http:", "https:", ""])}//{t.upper()}/p?q">t</a><a href="/local">l</a>' for t in to)
        rows.append((k, f"https://{host.title()}{rng.choice(['/fr/a', '/de/', '/en/1', '/es/', '', '?x', '/en/2#y'])}", html, "v", 0))
        for t in to:
            if t != host:
                links[host, t] = links.get((host, t), 0) + 1
    rows += [(900, None, None, "v", 0), (901, "no address", "<a href='http://h1.net'>", "v", 0), (None, "http://H1.net/x", None, "v", 0), (902, "", "", "v", 0), (5, rows[5][1], None, "v", 0)]
    got = U.judge(spark.createDataFrame(rows, SCHEMA), rounds=80, tolerance=1e-12).collect()
    good, bad = {}, {}
    for _, url, *_ in rows:
        host, path = split(url)
        rule = fitting(host, path)
        if rule:
            side = good if rule[2] == "allow" else bad
            side[host] = side.get(host, 0) + 1
    hosts = sorted({split(r[1])[0] for r in rows} - {""} | {h for pair in links for h in pair})
    trust, distrust = walk(hosts, links, good), walk(hosts, {(b, a): n for (a, b), n in links.items()}, bad)
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = split(urls[r.page_id])
        rule = fitting(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        if host:
            assert abs(r.trust - trust[host]) < 1e-6 and abs(r.distrust - distrust[host]) < 1e-6
        assert r.verdict == (rule[2] if rule else "block" if host and distrust[host] > trust[host] else "allow")


def test_empty(spark):
    assert U.judge_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_walks_are_not_ended_early(spark):
    seeds = spark.createDataFrame([(f"h{k}", 1.0 if k == 0 else 0.0) for k in range(24)], "host string, seed double")
    links = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(23)], "src string, dst string, n long")
    got = {r.host: r.score for r in U.rank(seeds, links, tolerance=0.02).collect()}  # 0.85^20 is 0.039
    assert all(got[f"h{k}"] > 0 for k in range(24)) and abs(sum(got.values()) - 1) < 1e-9
    far = {r.host: r.score for r in U.rank(seeds, links, tolerance=0.5).collect()}  # met long before the end of the chain
    assert far["h23"] > 0
