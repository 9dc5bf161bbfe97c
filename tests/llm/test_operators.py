"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import difference
from tokenizers import Tokenizer

from spindle.llm import bpe, embedding_dedup, html_text, jaccard_join, mixing, packing, perplexity, quality_rules, substring_dedup, suffix_dedup, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, k long, component_id string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def texts():
    rng = random.Random(5)
    vocab = ["the", "Of", "and", "naïve", "to", "été", "x1", "don't", "Zü"] + ["w%d" % i for i in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = make(120), make(70)
    near = base.split()
    near[60] = "changed"
    out = [None, "", " \n\t", "one", "a b c d", base, base, base.upper(), " ".join(near), make(40) + " " + passage + " " + make(30), passage + "\n" + make(55), "ab " * 400, "line\nline\n\nline two\n" + make(60), make(5000), "x" * 3000, "<|endoftext|> a <|endoftext|>  b"]
    return out + [make(rng.randrange(20, 200)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else 6, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 0, "r", "s", 1, "c") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def test_token_counts(spark, docs):
    tk = Tokenizer.from_file(BYTE)
    got = sorted(tuple(r) for r in tokens.token_counts(docs, BYTE, limit=20).collect())
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(tk.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert [g[:3] for g in got] == want and all(g[3] == (g[2] > 20) for g in got)
    assert tokens.token_counts(docs.limit(0), BYTE).count() == 0


def test_longest_cut_at_the_limit():
    counter, rng = bpe.prefix_counter(BYTE), random.Random(3)
    for t in ["aesra hh1\n\naé", *("".join(rng.choice("aeTths 'r\n\n  12é日<|>") for _ in range(rng.randint(1, 40))) for _ in range(300))]:
        every = counter.prefixes(t)
        for limit in range(1, 9):
            assert counter.within(t, counter.table(t), limit) == max(c for c, n in enumerate(every) if n <= limit), (t, limit)


def test_every_prefix_is_exact():
    tk, counter, rng = Tokenizer.from_file(BYTE), bpe.PrefixCounter(BYTE), random.Random(2)
    for t in ["don't  stop\n\n now", "naïve<|endoftext|>x", *("".join(rng.choice("aeTths 'r\n12é日<|>") for _ in range(30)) for _ in range(60))]:
        assert counter.prefixes(t) == [len(tk.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]


def test_mixing(spark, docs):
    a, b = (sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == docs.count() and all(0 <= r[5] <= 3 for r in a)
    total, targets = sum(r[2] for r in a), {r[1]: r[4] for r in a}
    assert abs(sum(targets.values()) - total) < 1e-6 and all(r[4] <= 3 * r[3] for r in a)
    assert difference(spark, mixing.query, mixing.SQL, "/root/testdata/sf0.001") == ""


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 36)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect())
    want = []
    for r in docs.collect():
        w, t = words(r["text"]), r["text"] or ""
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(triples)
        cover = {j for i, x in enumerate(triples) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want)
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_suffix_dedup(spark, docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        starts = int(gone[0:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), starts, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)


def test_substring_dedup_hot_passage(spark):
    """A passage that a third of all rows have, equal ids, null ids and texts, and clashing names; five batches."""
    hot = [f"h{k}" for k in range(60)]
    rows = [(i, hot + [f"{i}w{k}" for k in range(5)] if i % 3 == 0 else [f"{i}w{k}" for k in range(70)]) for i in range(5, 125)]
    rows += [(5, hot), (7, hot[:50]), (None, hot), (200, []), (201, None)]
    first: dict = {}
    for i, w in rows:
        for p in range(len(w or []) - 49):
            if i is not None:
                key = tuple(w[p : p + 50])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, w in rows:
        gone = [False] * len(w or [])
        for p in range(len(gone) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(gone), sum(gone), " ".join(x for x, g in zip(w or [], gone) if not g)))
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), 1, "x") for i, w in rows], "doc_id long, text string, core int, low string")
    got = [tuple(r) for r in substring_dedup.remove_known(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] > 0 for w in want) > 30


@pytest.mark.parametrize("batches", [1, 6])
def test_substring_dedup(spark, docs, batches):
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    first: dict = {}
    for i, w in sorted(rows):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substring_dedup.remove_known(docs, batches=batches).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    if batches > 1:
        return
    named = docs.selectExpr("printf('%06d', doc_id) AS doc_id", "text")
    assert sorted((int(r[0]), *r[1:]) for r in substring_dedup.remove_known(named, batches=2).collect()) == sorted(want)
    assert substring_dedup.remove_known(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    tk = Tokenizer.from_file(WORD)
    ids = collections.Counter()
    for r in docs.collect():
        ids[r["doc_id"], tuple([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2])] += 1
    out = packing.pack(docs, WORD, group=4096 * 2).collect()
    assert sum(r["length"] for r in out) == sum(len(k[1]) * n for k, n in ids.items())
    whole = {(d, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()), s, n) for d, x in ids for r in out if r["doc_id"] == d for s, n in [(r["start"], r["length"])]}
    assert all((r["doc_id"], r["ids_crc32"], r["start"], r["length"]) in whole for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    # each id lies in exactly one piece (rows with equal ids are told apart by their tokens)
    covered: collections.Counter = collections.Counter()
    for r in out:
        covered.update((r["doc_id"], r["doc_tokens"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert covered == collections.Counter((d, len(x), k) for (d, x), n in ids.items() for k in range(len(x)) for _ in range(n))
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_packing_fills_windows_to_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "and"]) for _ in range(rng.randrange(50, 400))), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for targets in (None, {"a": 1.0, "b": 1.0, "c": 2.0}, {"a": 3.0, "b": 1.0}):
        by = collections.defaultdict(collections.Counter)
        for r in packing.pack(df, WORD, targets=targets).collect():
            by[r["sequence_id"]][r["source"]] += r["length"]
        share = {k: v / sum(targets.values()) for k, v in targets.items()} if targets else dict.fromkeys("abc", 1 / 3)
        early = [by[k] for k in sorted(by)[:4]]
        for window in early:
            assert all(abs(window[s] - 4096 * share.get(s, 0.0)) < 300 for s in "abc"), (targets, window)


def test_jaccard_join(spark, docs):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    top = list(range(len(rows)))

    def find(x):
        return x if top[x] == x else find(top[x])

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(rows))


def test_jaccard_join_settles_a_hot_group_with_stragglers(spark):
    dice, texts = random.Random(5), []
    for _ in range(120):
        w = [f"w{i}" for i in range(150)]
        for _ in range(dice.choice([1, 2, 3, 3, 4, 5, 6])):
            w[dice.randrange(150)] = f"x{dice.randrange(10**6)}"
        texts.append(" ".join(w))
    test_jaccard_join(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.concatenate([base, base[:20] + 0.03 * rng.standard_normal((20, 16)), base[:5]]))]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, rows[0][1], None), (104, [1.0, None] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if i < 100]
    links = collections.Counter()
    for i, v, c in good:
        for j, w, d in good:
            if i < j and c == d and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(100, 105))
    found = sum(got[i]["n_links"] for i, _, _ in good)
    assert 0.9 * sum(links.values()) <= found and all(got[i]["n_links"] <= links[i] for i, _, _ in good)


def test_html_text(spark):
    page = '<html><body><nav><a href=/>Home</a></nav><div class="post"><h1>T &amp; t</h1><p>One<br>two<p>three <b>b</b></div><div id="comments">nice</div><div class="ad">buy</div><footer>f</footer><script>"<p>x</p>"</script>'
    df = spark.createDataFrame([(1, "http://h/a", page), (2, None, None), (3, "http://h/b", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {1: "T & t\n\nOne two\n\nthree b", 2: "", 3: ""}


PROSE = "Some plain prose that goes on for a while, as the text of an article does, and then ends with a stop. "


@pytest.mark.parametrize("page", ['<body class="has-sidebar"><article><p>{}</article>', '<body class="category-legal"><div class="post"><p>{}</div>', '<body><div class="content no-sidebar"><p>{}</div>', '<body><article><div class="widget-area-none"><p>{}</div></article>', '<body><div class="sidebar-layout"><nav>x</nav><p>{}</div>', '<body><div class="widget"><p>{}</div>'])
def test_html_text_never_loses_the_article(page):
    assert html_text.extract(page.format(PROSE), []) == PROSE.strip()


def test_html_text_by_the_votes_of_a_host(spark):
    page = lambda i: f'<body><div class="teaser">{PROSE * (3 if i == 3 else 0)}</div><div class="col{i}"><div class="story"><h1>T{i}</h1><p>{PROSE}</p></div></div><div class="comment-list"><p>{PROSE * 4}</p></div></body>'
    df = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(6)] + [(9, "http://other/", page(3))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert all(got[i] == f"T{i}\n\n{PROSE.strip()}" for i in range(6)), got
    assert got[9] != got[3]  # alone on its host, its own best container wins
    assert html_text.main_text(df.limit(0)).count() == 0


def test_html_text_takes_deep_pages():
    deep = "<div>" * 5000 + "<p>deep text" + "</div>" * 5000
    assert html_text.extract(deep, []) == "deep text"


def _plain_kneser_ney(taught):
    """Perplexities by dictionaries of words: interpolated modified Kneser-Ney of order 2, nothing of the module used."""

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        rate = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0), k) if a else k / 2
        return [0, rate(1, n[0], n[1]), rate(2, n[1], n[2]), rate(3, n[2], n[3])]

    pairs: collections.Counter = collections.Counter()
    for t in taught:
        if words(t):
            pairs.update(zip([None, *words(t)], [*words(t), ()]))
    total, follow, before = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        follow[a].append(n)
        before[b] += 1
    d, e, all_ = discounts(list(pairs.values())), discounts(list(before.values())), max(len(pairs), 1)
    base = (sum(e[min(n, 3)] for n in before.values()) or 1.0) / (len({*before, *total}) + 1)

    def score(t):
        if not words(t):
            return None
        logp = 0.0
        for a, b in zip([None, *words(t)], [*words(t), ()]):
            lower = (max(before[b] - e[min(before[b], 3)], 0) + base) / all_
            back = max(sum(d[min(n, 3)] for n in follow[a]) / total[a], 1e-6) if total[a] else 1.0
            own = max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / total[a] if total[a] else 0.0
            logp += np.log(own + back * lower)
        return np.exp(-logp / (len(words(t)) + 1))

    return score


def test_perplexity_is_that_of_plain_kneser_ney(spark, docs):
    every = [r["text"] for r in docs.collect()]
    for taught in (every, every[::2], ["a b", "c"], []):
        want = _plain_kneser_ney(taught)
        got = _scores(spark, taught, every)
        assert len(got) == len(every)
        for i, t in enumerate(every):
            assert got[i] == (want(t) if want(t) is None else pytest.approx(want(t), rel=1e-4))


def test_classifier_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(36)], "doc_id long, quality int, toxic int")
    out = perplexity.classify(docs, labels).collect()
    assert len(out) == docs.count() and not any(r["kept"] for r in out if r["n_words"] == 0)
    # each language has a threshold of its own
    assert len({(r["lang"], r["threshold"]) for r in out}) == len({r["lang"] for r in out})
    assert perplexity.classify(docs.limit(0), labels).count() == 0
    assert all(r["kept"] == (r["n_words"] > 0) for r in perplexity.classify(docs, labels.limit(0)).collect())


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(36)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = step, stage(spark, step, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        step = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert step.columns == corpus_pipeline.COLUMNS
        if k == 1:
            want = {r["doc_id"] for r in jaccard_join.near_duplicates(before).collect() if r["doc_id"] == r["component_id"]}
            assert len(want) == step.count()
    assert step.count() > 0


def _scores(spark, taught, asked, shards=16):
    teach = spark.createDataFrame([(t,) for t in taught], "text string")
    scratch = perplexity.Scratch(spark, "t")
    model, tables, seen = perplexity._trained(teach, shards, scratch)
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    return {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(rows, model, tables, seen, shards, ["doc_id"], "text", scratch).collect()}


def test_perplexity_is_the_same_without_common_entries(spark, docs, monkeypatch):
    taught = [r["text"] for r in docs.collect() if r["text"]]
    want = _scores(spark, taught[::2], taught)
    monkeypatch.setattr(perplexity, "COMMON", 0)
    assert _scores(spark, taught[::2], taught) == pytest.approx(want)


def test_perplexity_keeps_pairs_seen_once(spark):
    score = _scores(spark, ["a b", "c d", "g h", "i j", "e f", "e f"], ["a b", "a d"])
    assert score[0] < score[1]


def test_perplexity_sends_few_small_pieces(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(2000)]
    teach = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(perplexity, "COMMON", 0)  # so all keys are sent
    ran, plain = [], type(teach).mapInArrow
    monkeypatch.setattr(type(teach), "mapInArrow", lambda self, f, *a, **k: (ran.append(f), plain(self, f, *a, **k))[1])
    scratch, shards = perplexity.Scratch(spark, "t"), 16
    model, tables, seen = perplexity._trained(teach, shards, scratch)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    perplexity.perplexities(rows, model, tables, seen, shards, ["doc_id"], "text", scratch)
    batch = pa.RecordBatch.from_pydict({"row": list(range(2000)), "text": texts, "c0": list(range(2000))})
    sent = [r for b in ran[-1](iter([batch])) for r in b.to_pylist() if r["shard"] >= 0]
    assert 0 < len(sent) <= 2 * shards
    assert sum(len(r["keys"]) + len(r["docs"]) for r in sent) < 6 * 2000 * (62 + 61)


def test_pair_codes_undo():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << perplexity.RANK_BITS, (2, 5000))
    code = perplexity._code(a, b)
    assert code.max() < 1 << perplexity.CODE_BITS and np.bincount(perplexity._shards(code, 10).astype(int)).min() > 400
    assert all((x == y).all() for x, y in zip(perplexity._decode(code), (a, b)))


def test_perplexity_is_the_same_with_few_numbered_words(spark, docs, monkeypatch):
    taught = [r["text"] for r in docs.collect() if r["text"]]
    want = _scores(spark, taught[::2], taught)
    common = perplexity._common
    monkeypatch.setattr(perplexity, "_common", lambda rows, n, most: common(rows, n, 8 if most == 1 << perplexity.RANK_BITS else 0))
    assert _scores(spark, taught[::2], taught, shards=5) == pytest.approx(want)


def test_perplexity_leaves_no_copies_on_disk(spark, docs, monkeypatch):
    import pickle

    taught = [r["text"] for r in docs.collect() if r["text"]]
    scratch, there = perplexity.Scratch(spark, "t"), {}
    save = perplexity.Scratch.save
    monkeypatch.setattr(perplexity.Scratch, "save", lambda self, df, name, small=False: (there.update({name: {p.rsplit("-")[-1] for p in self.paths}}), save(self, df, name, small))[1])
    teach = scratch.save(spark.createDataFrame([(t,) for t in taught], "text string"), "texts")
    model, tables, seen = perplexity._trained(teach, 16, scratch)
    # texts are gone once pairs are there, pairs before the rare ones are joined, entries before questions
    assert "texts" in there["pairs"] and not any("texts" in v for k, v in there.items() if k in ("words", "rare", "others"))
    assert "pairs" not in there["others"] and {p.rsplit("-")[-1] for p in scratch.paths} == {"model"}
    # questions go to the model, which stays where it is
    rows = spark.createDataFrame(list(enumerate(taught)), "doc_id long, text string")
    plan = perplexity.perplexities(rows, model, tables, seen, 16, ["doc_id"], "text", scratch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(shard") == 1 and "Bucketed: true" in plan
    # broadcasts are packed, as all executors keep a copy, and hold the same when unpacked
    sent = pickle.dumps((tables, perplexity._Bits(seen)))
    got, bits = pickle.loads(sent)
    assert len(sent) < 1 << 20 and (bits.bits == seen).all() and len(got.values) > 300
    for x, y in ((got.known.keys, tables.known.keys), (got.entries.keys, tables.entries.keys), (got.values, tables.values), (got.of_words, tables.of_words)):
        assert np.array_equal(x, y, equal_nan=x.dtype.kind == "f")


def test_among_moves_no_rows(spark, monkeypatch):
    from spindle.llm import bits

    rows = spark.createDataFrame([(i % 400 if i % 7 else None, f"t{i}") for i in range(1000)], "k long, text string")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 600, 3), 3]], "k long")
    want = sorted(r["text"] for r in rows.collect() if r["k"] is not None and r["k"] % 3 == 0)
    monkeypatch.setattr(bits, "BITS", 1 << 9)  # lets many wrong keys through
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1 << 20, 0):
            monkeypatch.setattr(bits, "WRONG", most)
            out = bits.among(rows, ids, "k", perplexity.Scratch(spark, "t"))
            moved = "Exchange hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()
            assert moved == (most == 0) and sorted(r["text"] for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quality_rules_threshold_covers_all_held_out_rows(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) for _ in range(80))) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels, sample=5).selectExpr("*", "pmod(xxhash64(doc_id), 2) AS fold").collect()
    held = [r for r in out if r["fold"] == 1 and not r["base_failed"]]
    assert len(held) > 50 and all(r["kept"] for r in held)


def test_perplexity_threshold_uses_both_labels():
    steps = {s: (1, 0) for s in range(980)} | {s: (1, 20) for s in range(980, 1000)} | {1000: (0, 10)}
    share = perplexity._share({("en",): steps, None: steps}, 0.003)
    limit = perplexity._limits({("en",): steps}, share)[("en",)]
    assert sum(bad for s, (_, bad) in steps.items() if s > limit) >= 0.9 * 410
    only = {s: (n, 0) for s, (n, _) in steps.items()}
    assert perplexity._share({("en",): only, None: only}, 0.003) == 0.003
