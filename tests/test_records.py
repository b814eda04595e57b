import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quartzlake.functions import fuzzy
from quartzlake.operators import api, dedupe, graph, news, records, views
from quartzlake.operators.api import InvalidParameter
from quartzlake.operators.index_score import check_weights


def test_ratios_against_a_plain_definition():
    rng, plain = random.Random(3), lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for _ in range(1500):
        a, b = ("".join(rng.choice("acd  ") for _ in range(rng.randrange(18))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        got = fuzzy.token_set_ratio(a, b)
        if not x & y:
            assert got == 0
        else:
            s = " ".join(sorted(x & y))
            p, q = ((s + " " + " ".join(sorted(z))).strip() for z in (x - y, y - x))
            assert got == max(round(100 * plain(*k)) for k in ((s, p), (s, q), (p, q)))
        assert all(fuzzy.reaches(least)(a, b) == (got >= least) for least in (40, 80))
        short, far = (a, b) if len(a) <= len(b) else (b, a)
        best = 0.0
        for i, j, size in difflib.SequenceMatcher(None, short, far).get_matching_blocks():
            if size:
                at = j - i if j > i else 0
                best = max(best, plain(short, far[at : at + len(short)]))
        assert fuzzy.partial_ratio(a, b) == (0 if not short else 100 if best >= 0.995 else round(100 * best))


TITLES = ["Acme raises profit", "Acme raises its profit", "profit raises acme", "Other firm sells plant", "Other firm sells old plant", "x", ""]


def stories(n):
    rng, rows = random.Random(4), []
    for i in range(n):
        body = rng.choice(["a long body of words here", "a long body of other words here", "nothing like it at all", ""])
        rows.append((i, rng.choice(TITLES), body, rng.choice(["reuters", "site", "Haber AA"]), rng.choice([None, "", f"http://u/{rng.randrange(n)}"]), rng.choice([None, rng.randrange(3000)]), "AUTO_PRICE_TABLE" if i % 17 == 0 else "NEWS"))
    return rows


def brute_groups(rows, stocks):
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    agency = lambda s: "aa" in s.lower() or "reuters" in s.lower()
    live = [r for r in rows if r[6] != "AUTO_PRICE_TABLE"]
    root, why = {r[0]: r[0] for r in live}, {}
    for a, b in itertools.combinations(live, 2):
        near = abs(a[5] - b[5]) if a[5] is not None and b[5] is not None else None
        title = fuzzy.token_set_ratio(norm(a[1]), norm(b[1]))
        body = fuzzy.token_set_ratio(norm(a[2]), norm(b[2])) if title >= 85 else 0
        keys = {w for w in norm(a[1]).split() if len(w) >= 4} & {w for w in norm(b[1]).split() if len(w) >= 4}
        got = [c for c, ok in zip(dedupe.REASONS, (a[4] and a[4] == b[4], title >= 85 and body >= 80, near is not None and near <= 30 and title >= 85, near is not None and near <= 360 and len(keys) >= 2 and stocks.get(a[0]) is not None and stocks.get(a[0]) == stocks.get(b[0])), strict=False) if ok]
        if got and agency(a[3]) != agency(b[3]):
            got.append("AGENCY_COPY")
        if got:
            why[a[0], b[0]] = set(got)
            x, y = sorted((root[a[0]], root[b[0]]))
            root = {k: x if v == y else v for k, v in root.items()}
    out = {}
    for r in live:
        mine = [x for x in live if root[x[0]] == root[r[0]]]
        best = min(mine, key=lambda x: (not agency(x[3]), x[5] is None, x[5] or 0, -len(x[2]), x[0]))
        codes = set().union(*[c for (i, _), c in why.items() if root[i] == root[r[0]]], set())
        out[r[0]] = (best[0], len(mine), codes, not ("AGENCY_COPY" in codes and agency(best[3]) and not agency(r[3])))
    return out | {r[0]: (r[0], 1, set(), True) for r in rows if r[6] == "AUTO_PRICE_TABLE"}


def test_dedupe_against_all_pairs(spark):
    rows = stories(90)
    stocks = {r[0]: r[0] % 3 for r in rows if r[0] % 4}
    df = spark.createDataFrame(rows, "news_id long, title string, body string, source_name string, url string, at long, content_type string")
    got = dedupe.dedupe(df, spark.createDataFrame(list(stocks.items()), "news_id long, stock_id long"))
    assert {r.news_id: (r.canonical_id, r.group_size, set(r.reasons), r.credit) for r in got.collect()} == brute_groups(rows, stocks)


def edited(rng, words, base):
    """A text with some of its words replaced, dropped or changed by a letter, on both sides of the bound for bodies."""
    share, out = rng.choice([0.02, 0.1, 0.2, 0.3, 0.45, 0.6]), []
    for w in base:
        if rng.random() >= share:
            out.append(w)
        elif rng.random() < 0.7:
            out.append(rng.choice([rng.choice(words), w + rng.choice("xyz")]))
    return " ".join(out[: rng.choice([len(out), len(out) // 2])])


def test_long_bodies_against_all_pairs(spark):
    """Bodies of all lengths, over and under the one from which the matcher leaves frequent letters out."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvyz") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (8, 30, 60, 150, 400)]
    rows = [(i, TITLES[i % 5], edited(rng, words, rng.choice(bases)), "site", None, None, "NEWS") for i in range(90)]
    df = spark.createDataFrame(rows, "news_id long, title string, body string, source_name string, url string, at long, content_type string")
    got = {r.news_id: (r.canonical_id, r.group_size, set(r.reasons), r.credit) for r in dedupe.dedupe(df, spark.createDataFrame([], "news_id long, stock_id long")).collect()}
    assert got == brute_groups(rows, {}) and 3 < len({c[0] for c in got.values()}) < 90


def test_bounds_of_the_matcher():
    rng = random.Random(12)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(25))) for _ in range(2))
        table = [0] * (len(b) + 1)
        for x in a:
            old, table = table, [0]
            for j, y in enumerate(b):
                table.append(old[j] + 1 if x == y else max(old[j + 1], table[j]))
        assert fuzzy.subsequence(a, b) == table[-1] >= sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        shared = set(a.split()) & set(b.split())
        assert sum(map(min, fuzzy.profile(a, 4), fuzzy.profile(b, 4))) >= sum(len(t) + 1 for t in shared) == sum(map(min, fuzzy.profile(" ".join(shared), 4), fuzzy.profile(" ".join(shared), 4)))


def test_windows_connect_as_all_pairs(spark):
    """Links of a window: each of them in it, and the same components as of all pairs, also for a hot key and repeated times."""
    rng = random.Random(13)
    rows = [(i, rng.choice(["hot"] * 3 + ["k", None]), rng.choice([None, -rng.randrange(400), rng.randrange(3000)])) for i in range(250)] + [(900, "even", 0), (901, "even", 30), (902, "even", 60), (903, "even", 91)]
    times = {i: at for i, _, at in rows}
    df = spark.createDataFrame(rows, "news_id long, title string, at long")
    got = [(r.hi, r.lo) for r in dedupe._in_window(df, ["title"], 30, "R").collect()]
    assert all(abs(times[hi] - times[lo]) <= 30 for hi, lo in got)

    def merged(links):
        root = {i: i for i, _, _ in rows}
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        return root

    near = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] is not None and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 30]
    assert merged(got) == merged(near) and merged(got)[902] == 900 and merged(got)[903] == 903
    assert dedupe._in_window(df.limit(0), ["title"], 30, "R").count() == 0


def one_way_titles(n):
    """Pairs of titles, the first alike to the second but not the second to the first."""
    rng, words = random.Random(8), ["acme", "profit", "rises", "firm", "old", "plant", "sale", "bank", "big", "a", "of"]
    out = []
    while len(out) < n:
        base = rng.sample(words, rng.randrange(2, 5))
        a, b = (" ".join(rng.sample(base + [w + x for w, x in zip(rng.sample(words, 2), rng.choices("xyz", k=2), strict=True)], len(base) + 1)) for _ in range(2))
        if (fuzzy.token_set_ratio(a, b) >= 85) != (fuzzy.token_set_ratio(b, a) >= 85):
            out.append((a, b) if fuzzy.token_set_ratio(a, b) >= 85 else (b, a))
    return out


def test_dedupe_keeps_the_order_of_the_texts(spark):
    """Titles and bodies that are alike in one order only, in both orders of ids, near and far in time, and repeated."""
    rng, rows = random.Random(5), []
    for a, b in one_way_titles(4):
        for x, y in ((a, b), (b, a)):
            at = rng.randrange(10**6)
            rows += [(x, "one body", at), (y, "other text", at + rng.choice([3, 29, 31]))]
            rows += [("same title " + x[:3], x, None), ("same title " + x[:3], y, None)]
        rows += [(a, "again", 5), (b, "once more", 20), (a, "again", 33)]
    rows = [(i, t, body, "site", None, at, "NEWS") for i, (t, body, at) in enumerate(rows)]
    df = spark.createDataFrame(rows, "news_id long, title string, body string, source_name string, url string, at long, content_type string")
    got = dedupe.dedupe(df, spark.createDataFrame([], "news_id long, stock_id long"))
    want = brute_groups(rows, {})
    assert {r.news_id: (r.canonical_id, r.group_size, set(r.reasons), r.credit) for r in got.collect()} == want
    assert {len(c[2]) for c in want.values()} >= {0, 1}


def test_completion(spark):
    rows = [("STAGING-1", "READY", 80, 1.0, 5, [], 1, 0, 0, 0), ("STAGING-1", "FAILED", 0, None, None, ["price_availability"], 0, 0, 0, 0), ("LIVE-2", None, 101, 0.0, 0, ["price_availability"], None, None, None, None)]
    scan = spark.createDataFrame(rows, "run_id string, state string, data_confidence int, last_price double, volume long, missing_fields array<string>, kap_count long, news_count long, action_count long, restriction_count long")
    found = records.completion(scan, spark.createDataFrame([("STAGING-1", 2), ("LIVE-2", 2), ("STAGING-3", 0)], "run_id string, expected long")).collect()
    passed = {run: {r.criterion for r in found if r.run_id == run and r.passed} for run in ("STAGING-1", "LIVE-2", "STAGING-3")}
    assert passed == {"STAGING-1": {"UNIVERSE_VERIFIED", "ALL_SCANNED", "CHANNELS_COLLECTED", "MISSING_NOT_ZEROED", "CONFIDENCE_PER_STOCK"}, "LIVE-2": {"NO_STOCK_FAILED"}, "STAGING-3": {"ALL_SCANNED", "MISSING_NOT_ZEROED", "NO_STOCK_FAILED"}}


def test_best_name_against_all_names(spark):
    titles = [(i, t) for i, t in enumerate(TITLES)]
    names = [(1, "acme profit"), (2, "old plant firm"), (3, "nothing")]
    got = {r.news_id: (r.best, r.score) for r in news.best_names(spark.createDataFrame(titles, "news_id long, title string"), spark.createDataFrame(names, "name_id long, name string")).collect()}
    for i, t in titles:
        score = {k: fuzzy.token_set_ratio(t.lower(), n) for k, n in names}
        best = max(score.values())
        assert got[i] == ((min(k for k in score if score[k] == best), best) if best else (None, 0))


def test_pointers(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 70)] + [(200, 100)], "node long, up long")
    assert {r.node: (r.far, r.steps) for r in graph.ends(chain).collect()} == {k: (0, k) for k in range(1, 70)} | {200: (100, 1)}
    assert graph.ends(chain.limit(0)).count() == 0


def test_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "raw")], "record_id long, data_layer string")
    for bad in (lambda: records.in_layer(rows, "odd"), lambda: records.promote_layer(rows, rows, "raw", "validated"), lambda: records.archived(spark, str(tmp_path), "odd"), lambda: check_weights({"direction": 100})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(InvalidParameter):
        views.price_range(rows, 31)
    records.archive(spark.createDataFrame([("daily", 1), ("news", 2)], "kind string, x int"), str(tmp_path / "a"))
    assert [r.x for r in records.archived(spark, str(tmp_path / "a"), "news").collect()] == [2]
    assert views.canonical_only(rows.withColumn("canonical", F.lit(None).cast("boolean"))).count() == 1


def test_single_stock_lookup(spark):
    """Symbols as written, in upper and lower case; inactive, unlisted, unknown and null ones; a stock without a row."""
    stocks = spark.createDataFrame([("AB", None), ("cd", True), ("Ef", True), ("EF", False), ("GH", False), ("IJ", True), ("KL", True)], "symbol string, active boolean")
    asked = spark.createDataFrame([(1, "AB"), (2, "ab"), (3, "CD"), (4, "Ef"), (5, "ef"), (6, "gh"), (7, "ij"), (8, None), (9, "zz"), (10, "ab"), (11, "KL"), (12, "")], "request_id long, asked string")
    universe = spark.createDataFrame([("ab",), ("CD",), ("ef",), ("GH",), ("kl",), ("kl",), (None,)], "symbol string")
    rows = spark.createDataFrame([("AB", 1, "x"), ("cd", 2, "x"), ("Ef", 3, "x"), ("EF", 4, "x")], "symbol string, v long, debug string")
    got = views.single(views.looked_up(asked, stocks, universe), rows)
    assert "debug" not in got.columns
    none = (None, None, "SYMBOL_NOT_FOUND")
    want = {1: ("AB", 1, "OK"), 2: ("AB", 1, "OK"), 3: ("cd", 2, "OK"), 4: ("Ef", 3, "OK"), 5: none, 6: none, 7: none, 8: none, 9: none, 10: ("AB", 1, "OK"), 11: ("KL", None, "NOT_FOUND"), 12: none}
    assert {r.request_id: (r.symbol, r.v, r.code) for r in got.collect()} == want and got.count() == 12
    free = views.looked_up(asked, stocks, universe.limit(0))  # an empty universe leaves nothing out
    assert {r.request_id for r in free.where("symbol IS NOT NULL").collect()} == {1, 2, 3, 4, 7, 10, 11}
    assert views.looked_up(asked.limit(0), stocks, universe).count() == 0
    assert [r.asDict() for r in api.whole_list(asked.limit(0)).collect()] == [{"page": 1, "page_size": 1, "total": 0, "total_pages": 0}]
    assert api.whole_list(asked).first().asDict() == {"page": 1, "page_size": 12, "total": 12, "total_pages": 1}


def test_title_pairs_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """Titles with typos, tokens moved and tokens left out, met in blocks of 16."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(30)]
    titles = {" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(60)}
    for t in sorted(titles):
        k = rng.randrange(len(t))
        titles |= {(t[:k] + "z" + t[k + 1 :]).strip(), " ".join(reversed(t.split())), " ".join(t.split()[1:]) or "abc"}
    titles = sorted(titles)[:150] + [" ".join(words * 2)]
    monkeypatch.setattr(dedupe, "BLOCK", 16)
    like = lambda a, b: fuzzy.token_set_ratio(a, b) >= 85
    want = {(a, b, like(a, b), like(b, a)) for a in titles for b in titles if a < b and (like(a, b) or like(b, a))}
    found = dedupe.title_pairs(spark.createDataFrame([(t,) for t in set(titles)], "title string")).collect()
    assert len(found) == len(want) and {(r.a, r.b, r.ab, r.ba) for r in found} == want


def test_bounds_spare_the_matcher(monkeypatch):
    """Texts of like lengths and characters, but in another order, are told apart without the matcher."""
    monkeypatch.setattr(fuzzy, "SequenceMatcher", None)
    assert fuzzy.reaches(85)("x abcdefghij klmnopqrst", "x tsrqponmlk jihgfedcba") == 0


def test_bodies_of_a_group_with_like_texts_are_not_compared(spark):
    """News 1 and 2 are linked by their texts, 3 to 1 by its time: the body of 3 tells nothing new; that of 4 does."""
    body = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    rows = spark.createDataFrame([(1, "t", body), (2, "t", body), (3, "t", body + " v"), (4, "t", body + " u")], "news_id long, title string, body string")
    known = spark.createDataFrame([(2, 1, "DUPLICATE_TEXT"), (3, 1, "DUPLICATE_EVENT_TIME")], "hi long, lo long, reason string")
    pairs = spark.createDataFrame([("t", "t", True, True)], "a string, b string, ab boolean, ba boolean")
    assert {(r.hi, r.lo) for r in dedupe.body_links(rows, pairs, known).collect()} == {(4, 1), (4, 3)}


def test_tokens_of_one_news_are_not_paired(spark):
    """Only tokens that several news of a stock have are paired; the links of one event are those of all pairs of tokens."""
    rows = [(1, 0, 7, ["aaaa", "bbbb", "only", "here"]), (2, 5, 7, ["aaaa", "bbbb", "cccc"]), (3, 400, 7, ["aaaa", "cccc"]), (4, 5, 8, ["aaaa", "bbbb"]), (5, None, 7, ["only", "here"]), (6, 9, None, ["aaaa", "bbbb"]), (7, 6, None, ["aaaa", "bbbb"])]
    pairs, _ = dedupe.token_pairs(spark.createDataFrame(rows, "news_id long, at long, stock_id long, keys array<string>"))
    got = sorted((r.news_id, r.at) for r in pairs.collect())
    assert got == [(1, 0), (2, 5), (2, 5), (2, 5), (3, 400)]
    assert [(r.hi, r.lo) for r in dedupe._in_window(pairs, ["x", "y"], 360, "R").collect()] == [(2, 1)]
