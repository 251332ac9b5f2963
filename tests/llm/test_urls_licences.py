import re
from pathlib import Path
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm.licences import NOTICES, TEXTS, normalised, op6_licence_digests, scan
from factloom.llm.url_filter import RULES, Settings, host_reputation, judge, op5_host_reputation, registered_domain, suffix, url_parts


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


SECOND = "ac co com edu gob gov govt go gouv mil ne net nom or org sch".split()


def plain_domain(host):
    name = re.sub(r":\d*$", "", host.rsplit("@", 1)[-1]).rstrip(".")
    labels = name.split(".")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", name) or ":" in name:
        return name
    return ".".join(labels[-(3 if len(labels) > 1 and labels[-2] in SECOND and re.fullmatch("[a-z]{2}", labels[-1]) else 2) :])


def plain_suffix(host):
    domain = plain_domain(host)
    return domain if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", domain) or ":" in domain or "." not in domain else domain.split(".", 1)[1]


def drawn_quantile(p, a, b):
    """By summing the density on a fine grid."""
    import numpy as np

    x = (np.arange(400_000) + 0.5) / 400_000
    w = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    w = np.cumsum(np.exp(w - w.max()))
    return float(x[np.searchsorted(w, p * w[-1])])


def plain_reputation(outcomes, s=Settings()):
    """Posterior (rate, upper) by (level, name), over (host, good) pairs."""
    hosts = defaultdict(lambda: [0.0, 0.0])
    for host, good in outcomes:
        hosts[host][0] += good
        hosts[host][1] += 1
    key = {"host": lambda h: h, "domain": plain_domain, "suffix": plain_suffix}
    counts = {level: defaultdict(lambda: [0.0, 0.0]) for level in key}
    for h, (g, n) in hosts.items():
        for level in key:
            c = counts[level][key[level](h)]
            c[0] += g
            c[1] += n
    total = [sum(c[k] for c in counts["suffix"].values()) for k in (0, 1)]

    def strength(children):
        g, n = sum(c[0] for c in children), sum(c[1] for c in children)
        m, nn = g / n, sum(c[1] ** 2 for c in children)
        extra = m * (1 - m) * (nn - n)
        r = (sum((c[0] - m * c[1]) ** 2 for c in children) - m * (1 - m) * n) / extra if extra > 0 else 0
        return min(max(1 / r - 1, s.least_strength), s.most_strength) if r > 0 else s.most_strength

    out = {}
    for level, up in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        for name, (g, n) in counts[level].items():
            if up is None:
                parent, children = (total[0] + 1) / (total[1] + 2), list(counts[level].values())
            else:
                parent = out[up, key[up](name)][0]
                children = [c for k, c in counts[level].items() if key[up](k) == key[up](name)]
            k = strength(children)
            a, b = parent * k + g, (1 - parent) * k + n - g
            rate = a / (a + b)
            out[level, name] = (rate, a, b)
    return out


URLS = ["http://A.Example.NET/en/x?q#f", "https://example.com/de/", "https://example.com/de", "ftp://x.org/fr/y", "no scheme", None, "", "http://", "http://net/", "http://internet/x", "http://h.net", "http://h.net?x/", "x://user@Host:80/p#a/b", "http://a.b.co/é?ü", "http://Éa.org/fr/"]


def test_parts_rules_and_edges(spark):
    pages = spark.createDataFrame([(k, u, "extra") for k, u in enumerate(URLS)] + [(None, URLS[0], "extra"), (0, URLS[0], "extra")], "page_id long, url string, rate string")
    host, path = url_parts(F.col("url"))
    assert [(r.h, r.p) for r in pages.select(host.alias("h"), path.alias("p")).collect()[: len(URLS)]] == [plain_parts(u) for u in URLS]
    none = spark.createDataFrame([], "page_id long, good int")
    rows = judge(pages, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        rule = plain_rule(r.host, r.path)
        assert (r.rule, r.verdict) == ((rule.name, rule.verdict) if rule else (None, "allow"))


def test_reputation_equals_plain_computation(spark):
    outcomes = [(f"h{k % 7}.d{k % 3}.{'com' if k % 2 else 'org'}", int(k % 5 != 0 and k % 7 != 3)) for k in range(200)] + [("bad.d0.com", 0)] * 30
    df = spark.createDataFrame(outcomes, "host string, good int")
    wanted, found = plain_reputation(outcomes), {(r.level, r.host): (r.rate, r.upper) for r in host_reputation(df).collect()}
    assert set(found) == set(wanted)
    for key, value in wanted.items():
        assert found[key][0] == pytest.approx(value[0], abs=1e-9), key
        assert found[key][1] == pytest.approx(drawn_quantile(Settings().certainty, *value[1:]), abs=2e-5), key
    assert found["host", "bad.d0.com"][1] < Settings().least_good


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.com:8080": ("x.com", "com"), "me:pw@www.x.org": ("x.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "a.b.c.de.": ("c.de", "de"), "": ("", ""), "[::1]": ("[::1]", "[::1]"), "x.com.au": ("x.com.au", "com.au")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", registered_domain(F.col("host")).alias("d"), suffix(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == hosts
    assert all((plain_domain(h), plain_suffix(h)) == hosts[h] for h in hosts if h != "co.uk")


def test_bad_hosts_are_blocked_and_good_ones_of_bad_domains_are_not(spark):
    pages, outcomes = [], []
    for host, n, bad in (("spam.shop.com", 60, 55), ("blog.shop.com", 60, 2), ("new.spam.co.uk", 0, 0), ("old.spam.co.uk", 80, 80), ("news.org", 90, 3), ("few.org", 2, 2), ("good.com", 300, 10)):
        for k in range(max(n, 1)):
            pages.append((len(pages), f"https://{host}/p{k}"))
            if k < n:
                outcomes.append((len(pages) - 1, int(k >= bad)))
    rows = judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()
    verdicts = {r.host: r.verdict for r in rows}
    assert verdicts == {"spam.shop.com": "block", "blog.shop.com": "allow", "new.spam.co.uk": "block", "old.spam.co.uk": "block", "news.org": "allow", "few.org": "allow", "good.com": "allow"}


def test_pages_without_rows_and_with_clashing_columns(spark):
    none = spark.createDataFrame([], "page_id long, good int")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge(empty, none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/fr/x")], "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path", "'v' as verdict", "1 as __rule", "2 as rate")
    r = judge(pages, none).first()
    assert (r.host, r.path, r.rule, r.verdict, r.rate) == ("a.org", "/fr/x", "org/fr/", "allow", None)


def test_query_equals_plain_computation(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rep = plain_reputation([(plain_parts(u)[0], labels[i]) for i, u in pages.items() if i in labels and plain_parts(u)[0]])
    rows = op5_host_reputation(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == plain_parts(pages[r.page_id])
        rule = plain_rule(r.host, r.path)
        best = next((rep[k] for k in (("host", r.host), ("domain", plain_domain(r.host)), ("suffix", plain_suffix(r.host))) if k in rep), None)
        assert r.rule == (rule.name if rule else None)
        assert r.verdict == (rule.verdict if rule else "block" if best and drawn_quantile(Settings().certainty, *best[1:]) < Settings().least_good else "allow")
        assert best is None or r.rate == pytest.approx(best[0], abs=1e-8)


def test_licence_texts_in_other_dress(spark, make_docs):
    mit = TEXTS[1][1]
    dressed = "Copyright (c) 2021 Some One\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(", ", " ,\n") + "\n\nCopyright 1999-2024 Other"
    rows = [(1, mit), (2, dressed), (3, mit + " and more"), (4, None), (5, ""), (6, "...\n!"), (7, f"some text\n  {NOTICES[4][1].replace('License', 'licence').upper()}\nmore"), (8, f"x {NOTICES[4][1]}"), (1, mit)]
    found = [(r.doc_id, r.licence, r.notices) for r in scan(make_docs(rows).withColumn("licence", F.lit("old"))).collect()]
    by_id = {i: (lic, n) for i, lic, n in found}
    assert len(found) == len(rows)
    assert by_id[1][0] == by_id[2][0] == "MIT" and by_id[3][0] is None
    assert by_id[4] == by_id[5] == by_id[6] == (None, [])
    assert by_id[7] == (None, ["MIT"]) and by_id[8] == (None, [])


def test_all_known_texts_are_found(spark, make_docs):
    rows = scan(make_docs([(k, t) for k, (_, t) in enumerate(TEXTS)])).collect()
    assert {r.doc_id: r.licence for r in rows} == {k: n for k, (n, _) in enumerate(TEXTS)}


INSTALLED = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_planted_installed_licences(spark, make_docs):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this system")
    texts = {name: (folder / file).read_text("utf-8") for file, name in INSTALLED.items()}
    dressed = {n: "\n".join(line.upper() for line in t.replace("License", "Licence").split("\n")) + "\nCopyright (c) 2020 Some One\n" for n, t in texts.items()}
    rows = [(k, t) for k, t in enumerate([*texts.values(), *dressed.values()])] + [(99, texts["GPL-3.0"][:-500])]
    found = {r.doc_id: r.licence for r in scan(make_docs(rows)).collect()}
    assert found == dict(enumerate([*texts, *dressed])) | {99: None}


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert scan(make_docs([])).count() == 0
    docs = make_docs([(1, TEXTS[0][1]), (2, "x\nAll Rights  Reserved\ny")]).selectExpr("*", "'d' as digest", "'n' as notices", "7 as licence")
    assert {r.doc_id: (r.licence, r.notices) for r in scan(docs).collect()} == {1: ("MIT", []), 2: (None, ["all-rights-reserved"])}


def test_spellings(spark, make_docs):
    texts = ["The Licence, licenced; Sub-Licence!", "WHILST organisation's favour", "copyright holders stay\n(c) 2020 goes\nAll rights reserved."]
    rows = make_docs(list(enumerate(texts))).select(normalised(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == ["the license licensed sublicense", "while organization s favor", "copyright holders stay"]


def test_licence_oracle(spark, sf, make_docs, tmp_path):
    import duckdb

    from factloom.llm.registry import ORACLES

    planted = [(10**6 + k, t + "\n\nCopyright 2020 Some One") for k, (_, t) in enumerate(TEXTS)] + [(2 * 10**6, f"a\n{NOTICES[0][1].upper()}\nAll rights reserved.\n{NOTICES[1][1]}"), (3 * 10**6, None)]
    both = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(make_docs(planted).select("doc_id", "text"))
    both.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(ORACLES["op6_licence_digests"])
    columns = [c[0] for c in wanted.description]
    found = op6_licence_digests(spark, f"file://{tmp_path}").select(*columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted.fetchall(), key=str)
    assert sum(r.licence is not None for r in found) == len(TEXTS)


def test_licence_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_licence_digests(spark, sf).collect()
    assert len(rows) == len(docs)
    lines = dict((t, n) for n, t in NOTICES)
    for r in rows:
        assert r.notices == ",".join(sorted({lines[x.strip()] for x in docs[r.doc_id].split("\n") if x.strip() in lines}))
    plan = op6_licence_digests(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
