"""Weak parts are linked by their distance alone, against brute force."""

from pyspark.sql import functions as F

from durata.llm import secret_scan


def slow_links(parts, reach=200):
    role = [secret_scan.ROLE[k[0]] for k in secret_scan.KINDS]
    out = set()
    for k, a, b in parts:
        if k < len(secret_scan.STRONG):
            continue
        near = [p for p in parts if max(p[1] - b, a - p[2]) <= reach]
        done = any(role[p[0]] != role[k] and "secret" in (role[p[0]], role[k]) for p in near)
        inside = any(p[0] < len(secret_scan.STRONG) and p[1] < b and a < p[2] for p in near)
        if done and not inside:
            out.add((k, a, b))
    return out


def test_secret_scan_links_do_not_depend_on_the_offset(spark):
    pair = "user: bobby" + "~" * 181 + "key: s3cr3t77"
    long_url = "https://db.example/" + "x" * 700 + " " * 150 + "key: s3cr3t77"
    rows = [("-" * k + "\n" + t,) for t in (pair, long_url) for k in range(0, 420, 7)]
    rows += [("-" * k + " user: bobby" + "~" * n + "key: s3cr3t77",) for k in range(150, 220, 9) for n in (199, 200, 201)]
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")
    found = secret_scan.parts(docs).where(F.col("kind").isNotNull()).collect()
    want = {(i, *x) for i in range(len(rows)) for x in slow_links([(r.kind, r.start, r.stop) for r in found if r.id == i])}
    got = {(r.id, r.kind, r.start, r.stop) for r in secret_scan.linked(secret_scan.parts(docs)).collect()}
    assert got == want and len({i for i, *_ in got}) == 2 * 60 + 8 * 2
