"""Mixing, line dedup, PII and URL filters."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linededup, mixing, pii, registry, urlfilter
from tests.llm.conftest import kept
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", ["op2_source_mixing", "op4_line_dedup", "op9_url_filters"])
def test_sql_twins(spark, small_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, small_dir).toPandas()
    assert rows_of(got) == rows_of(c.sql(registry.oracle_sql()[name]).df())


# --- mixing


def filled(sizes, cap=3):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left, w = total - sum(held.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return held | {s: left * weight[s] / w for s in free}
        held |= {s: cap * sizes[s] for s in over}


def test_water_fill(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 20, "d": 5, None: 500}, {"a": 0, "b": 7}, {"x": 3}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.water_fill(df).collect()}
        assert got == pytest.approx(filled(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def sainte_lague(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(sorted(votes), key=lambda v: votes[v] / (2 * got[v] + 1))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 3, 10, 97, 1000])
def test_apportion(spark, seats):
    votes = {"a": 5300, "b": 2400, "c": 1100, "d": 900, "e": 0, "f": 37}
    df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "p string, v long, s long")
    got = {r.p: r.q for r in mixing.apportion(df, [], ["p"], "v", "s", "q").collect()}
    assert got == sainte_lague(votes, seats)


def test_mix_whole(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source, r.target] += r.taken
        assert r.taken <= 3 * r["size"]
    assert all(abs(n - t) <= mixing.BLOCK for (_, t), n in by.items())
    again = mixing.mix(docs.repartition(5)).select("doc_id", "source", "mix.*").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_odd(odd_docs, no_docs):
    rows = kept(mixing.mix(odd_docs), odd_docs).select("c0", "text", "mix.*").collect()
    sizes = {r.c0: r["size"] for r in rows}
    assert sizes[3] == sizes[4] == sizes[5] == 0 and sizes[7] == 30000
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    assert mixing.mix(odd_docs.withColumn("mix", F.lit(1))).columns.count("mix") == 1


# --- line dedup


def windows_away(texts):
    """Brute force: later occurrences of three-line windows, in order of id and position."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].split("\n")
        at = [k for k, s in enumerate(raw) if s.strip()]
        gone = set()
        line, words = [raw[k].strip() for k in at], [raw[k].strip().count(" ") + 1 for k in at]
        for p in range(len(at)):
            for n in (1, 2, 3):
                long = n == 3 or (sum(words[p : p + n]) >= 50 and (n == 1 or max(words[p : p + n]) < 50))
                if p + n <= len(at) and long:
                    w = tuple(line[p : p + n])
                    if w in seen:
                        gone |= set(at[p : p + n])
                    seen.add(w)
        out[i] = "\n".join(s for k, s in enumerate(raw) if k not in gone)
    return out


def test_windows(spark):
    block = "\n".join(f"shared line {i}" for i in range(5))
    texts = {1: f"a\n{block}\nz", 2: f"b\n\n{block}\n\ny", 3: "\n".join(["same"] * 9), 4: "same\nsame", 5: block, 6: "q\nshared line 0\nshared line 1\nr", 7: "  shared line 2 \r\nshared line 3\nshared line 4"}
    passage, half = " ".join(f"p{i}" for i in range(60)), " ".join(f"h{i}" for i in range(30))
    texts |= {8: f"x\n{passage}\ny", 9: passage, 10: f"{half}\n{half}\nz", 11: f"u\n{half}\n\n{half}", 12: half, 13: f"{half}\nq"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).select("doc_id", "line_dedup.text").collect()}
    assert got == windows_away(texts)
    assert got[1] == texts[1] and got[5] == "" and got[4] == texts[4] and got[6] == texts[6] and got[3] == "same"
    assert got[9] == "" and got[11] == "u\n" and got[12] == half and got[13] == texts[13]


def test_windows_odd(odd_docs, no_docs):
    out = {r.c0: r for r in kept(linededup.dedup_lines(odd_docs), odd_docs).select("c0", "line_dedup.*").collect()}
    assert out[3].text is None and out[4].text == "" and out[3].n_lines == 0
    assert out[8].n_removed == 0 and out[9].n_removed == 4 and out[9].text == ""
    assert linededup.dedup_lines(no_docs).count() == 0


# --- PII

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 8 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_base_spans(spark):
    texts = [
        "a.b@c.d_e@f.g x@y @z.w q@-.-", "1.2.3.4.5.6.7.8 999.1.1.1.2.3.4 1.2.3.0004 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 34  5",
        "+1 (555) 123-4567 +12 34 +123456789012345 +1234567890123456 ++1 2345678", "😀 é a@b.cc +54 11 4444 5555", "9" * 30000, "a" * 30000 + "@", "a." * 5000 + "@b.c", None, "", "1 " * 9000, "1.2.3.4 " * 3000 + "5.6.7.8", "a@b.c," * 128,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", *[c.alias(k) for k, c in pii.base_spans(F.coalesce("text", F.lit(""))).items()]).collect()
    for r in got:
        assert [(k, s.start, s.end) for k in KINDS for s in r[k]] == base(texts[r.i])


def test_revealing_terms(spark):
    rows = [(i, f"Report {i} of item w{i} by Zarvoski: write to z.boss@firm.example soon about v{i}") for i in range(5)]
    rows += [(10 + i, f"write to us by soon about item w{i} of the report {i}") for i in range(40)] + [(60, "nothing but Zarvoski here"), (61, None), (62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(df).select("doc_id", "pii.*").collect()}
    assert [(s.start, s.end, s.value) for s in out[60].terms] == [(12, 20, "Zarvoski")]
    assert out[60].text == "nothing but <TERM> here" and out[61].text == "" and out[12].terms == []
    assert out[0].text == "Report 0 of item w0 by <TERM>: write to <EMAIL> soon about v0"
    # copies of one text are one context: no word of theirs is revealing
    copies = spark.createDataFrame([(i, "Zarvoski writes to z.boss@firm.example now") for i in range(9)], "doc_id long, text string")
    assert all(r.terms == [] for r in pii.sanitise(copies).select("pii.terms").collect())


@pytest.mark.parametrize("most", [0, 100_000])
def test_disclosure_by_brute_force(spark, monkeypatch, most):
    """Terms by counting texts; both ways of joining the candidates."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(4)
    people = {f"Name{c}": f"{c}.x@firm.example" for c in "abcd"}
    rows = []
    for _ in range(160):
        words = [rng.choice(["the", "report", "is", "due", "on", "a", "day", "Zo", "i"]) for _ in range(6)] + [f"w{rng.choice('klmnop')}"]
        if rng.random() < 0.35:
            who = rng.choice(list(people))
            words += [who] * (rng.random() < 0.9) + [people[who]] * (rng.random() < 0.8) + ["qx"] * (who == "Namea")
        rng.shuffle(words)
        rows.append(" ".join(words))
    rows += rows[:20]  # copies count once
    texts = set(rows)
    mails = {t: {m.group().lower() for m in re.finditer(KINDS["email"], t)} for t in texts}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(KINDS["email"], " ", t))} for t in texts}
    import math

    want = {}
    for e in set().union(*mails.values()):
        for w in set().union(*words.values()):
            n_e, n_t, n_et = (sum(1 for t in texts if f(t)) for f in (lambda t: e in mails[t], lambda t: w in words[t], lambda t: e in mails[t] and w in words[t]))
            if n_e >= 3 and n_et >= 3 and n_et / n_t >= 0.6:
                told = math.log(n_et / n_t * len(texts) / n_e) / math.log(len(texts) / n_e)
                if told >= 0.9:
                    want[w] = max(want.get(w, 0), told)
    assert want  # the data hold some
    out = pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("text", "pii.terms").collect()
    got = {s.value.lower(): s.disclosure for r in out for s in r.terms}
    assert got == pytest.approx(want)
    for r in out:
        clear = re.sub(KINDS["email"], lambda m: " " * len(m.group()), r.text)
        assert [(s.start, s.end) for s in r.terms] == [m.span() for m in re.finditer(r"[^\W\d_]+", clear) if m.group().lower() in want]


def test_many_spans_take_linear_time(spark):
    took = []
    for n in (4000, 16000):
        df = spark.createDataFrame([(1, "".join(f"a{i}@b.example and é😀 " for i in range(n)))], "doc_id long, text string")
        began = time.time()
        r = pii.sanitise(df).select("pii.text", F.size("pii.email").alias("n")).first()
        took.append(time.time() - began)
        assert r.n == n and r.text == "<EMAIL> and é😀 " * n
    assert took[1] < 8 * took[0] + 5


def test_pii_query(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in pii.op5_pii_sanitisation(spark, small_dir).collect():
        spans = base(texts[r.doc_id])
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()


def test_pii_odd(odd_docs, no_docs):
    out = kept(pii.sanitise(odd_docs), odd_docs).select("text", "pii.*").collect()
    assert all((r[0] or "") == r[-1] for r in out)
    assert pii.sanitise(no_docs).count() == 0


# --- URL filters


def test_as_of(spark):
    entries = [
        ("l", "domain", "bad.example", "block", "2024-01-10", "add"), ("l", "domain", "bad.example", "block", "2024-01-12", "add"), ("l", "domain", "bad.example", "block", "2024-01-20", "remove"),
        ("l", "domain", "good.bad.example", "allow", "2024-01-15", "add"), ("p", "prefix", "site.example/a/b", "block", "2024-01-01", "add"),
        ("l", "domain", None, "block", "2024-01-01", "add"), ("l", "domain", "x.example", "block", None, "add"), ("l", "domain", "site.example", "block", "2024-01-05", "remove"),
        ("l", "domain", "both.example", "block", "2024-01-05", "add"), ("l", "domain", "both.example", "block", "2024-01-05", "remove"),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, value string, verdict string, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cases = [
        ("https://a.BAD.example/x", "2024-01-09", "none"), ("https://a.BAD.example/x", "2024-01-10", "block"), ("http://bad.example:80", "2024-01-19 23:59:59", "block"), ("http://bad.example", "2024-01-20", "none"),
        ("http://good.bad.example/", "2024-01-14", "block"), ("http://good.bad.example/", "2024-01-16", "allow"), ("http://u@site.example/a/b?q=1", "2024-02-01", "block"), ("http://site.example/a/bc", "2024-02-01", "none"),
        ("http://site.example//a//b/c", "2024-02-01", "block"), ("http://notbad.example", "2024-01-15", "none"), ("no url", "2024-01-15", "none"), (None, "2024-01-15", "none"), ("http://bad.example", None, "none"), ("http://both.example", "2024-03-01", "none"),
        ("https://a.BAD.example/x", "2024-01-10", "block"),
    ]
    c = spark.createDataFrame([(i, u, t, i, i) for i, (u, t, _) in enumerate(cases)], "id int, url string, fetch_ts string, value int, row int").withColumn("fetch_ts", F.col("fetch_ts").cast("timestamp_ntz"))
    got = [(r.id, r.verdict) for r in urlfilter.filter_urls(c, e).orderBy("id").select("id", "list_match.verdict").collect()]
    assert got == [(i, v) for i, (_, _, v) in enumerate(cases)]
    assert [(r.id, r.verdict) for r in urlfilter.filter_urls(c, e, slices=3).orderBy("id").select("id", "list_match.verdict").collect()] == got
    assert urlfilter.filter_urls(c.limit(0), e).count() == 0
    assert {r[0] for r in urlfilter.filter_urls(c, e.limit(0)).select("list_match.verdict").collect()} == {"none"}


def keyed(url):
    """Brute force: (host, domains, prefixes) of a URL, by hand."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    name = m.group(1).rsplit("@", 1)[-1] if m else ""
    name = (name[: name.index("]") + 1] if name.startswith("[") else name.split(":")[0]).lower().rstrip(".")
    if not name:
        return set()
    parts = name.split(".")
    whole = name.startswith("[") or (len(parts) == 4 and all(x.isdigit() and len(x) < 4 for x in parts))
    steps = [x for x in m.group(2).split("/") if x]
    return {("domain", name if whole else ".".join(parts[i:])) for i in range(1 if whole else len(parts))} | {("prefix", "/".join([name, *steps[:i]])) for i in range(len(steps) + 1)}


def test_urls_by_brute_force(spark):
    rng = random.Random(9)
    hosts = ["Site.example", "a.site.example", "10.0.0.1", "1.10.0.0.1", "[2001:db8::1]", "site.example.", "x.y.z.example"]
    entries = []
    for _ in range(160):
        kind, h = rng.choice(["domain", "prefix"]), rng.choice(hosts + ["0.0.1", "example", "site.example:8080", "SITE.EXAMPLE"])
        path = rng.choice(["", "/", "/Docs", "/docs/", "//Docs//x", "/docs/x"]) if kind == "prefix" else ""
        entries.append((rng.choice("lm"), kind, h + path, rng.choice(["block", "allow"]), f"2024-01-{rng.randint(1, 28):02d}", rng.choice(["add", "add", "remove"])))
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/Docs', '/Docs/x?q', '/docs//x', '/docs/x#f', '/docsx'])}" for _ in range(250)]
    cases = [(i, u, f"2024-01-{rng.randint(1, 31):02d}") for i, u in enumerate(urls)]
    state = defaultdict(dict)  # the last change of each (entry, day); a removal wins on its day
    for l, k, v, w, day, action in entries:
        at = next(x for x in keyed("http://" + v) if x[0] == k and x[1] == max((y[1] for y in keyed("http://" + v) if y[0] == k), key=len))
        state[l, at, w][day] = max(action, state[l, at, w].get(day, ""))
    want = []
    for i, u, day in cases:
        own, active = keyed(u), []
        for (l, at, w), moves in state.items():
            past = [d for d in sorted(moves) if d <= day]
            if at in own and past and moves[past[-1]] == "add":
                active.append((len(at[1]), w == "allow", l, at[1], w))
        want.append((i, max(active)[4] if active else "none", len(active)))
    e = spark.createDataFrame(entries, "list string, kind string, value string, verdict string, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    c = spark.createDataFrame(cases, "id int, url string, fetch_ts string").withColumn("fetch_ts", F.col("fetch_ts").cast("timestamp_ntz"))
    got = [tuple(r) for r in urlfilter.filter_urls(c, e).orderBy("id").select("id", "list_match.verdict", "list_match.n_active").collect()]
    assert got == want
