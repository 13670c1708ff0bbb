"""Each operator against brute force, and on empty and odd tables."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oxbow.llm import contamination, langid, lexicon, linespread, media, neardup, repeats, sharding, shingles, surrogates, tokencount
from oxbow.llm.queries import DEMO_KEY, tokenizer_file

BPE = tokenizer_file("word_bpe_49k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "te") for b in ("ber", "dan", "fil", "gos", "hem", "jur", "kel", "lan", "mor", "nix")]


@pytest.fixture(scope="session")
def corpus(docs_of):
    """Copies, near copies, shared passages and clean documents, dealt over sites."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(20, 90)) for _ in range(40)]
    texts = list(base)
    for k, b in enumerate(base[:10]):
        texts += [b] * (k % 3)
        for _ in range(4):
            words = b.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    passage = prose(rng, 25)
    texts += [f"{prose(rng, 10)} {passage} {prose(rng, 10)}" for _ in range(12)]
    rng.shuffle(texts)
    return docs_of([(k * 3 + 1, t, "en", f"s{k % 7}", len(t)) for k, t in enumerate(texts)])


def rows_of(df):
    return df.collect()


# ---- 1 ----


def greedy(word, initial, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_piece_counts_equal_greedy_matching():
    rng = random.Random(3)
    for _ in range(200):
        initial = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)}
        inner = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(12)}
        counter = tokencount.PieceCounter(initial, inner)
        for _ in range(40):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert counter.count(word) == greedy(word, initial, inner), (word, initial, inner)


def test_token_counts(corpus, odd):
    initial, inner = map(set, tokencount.pieces_of(PIECES))
    for table in (corpus, odd.where("length(text) < 90000 or text is null")):
        texts = table.select("doc_id", "text").collect()
        got = tokencount.count_tokens(table, PIECES).collect()
        want = []
        for r in texts:
            words = tokencount.WORD.findall(r["text"] or "")
            counts = [greedy(w, initial, inner) for w in words]
            want.append((r["doc_id"], len(words), sum(1 if c < 0 else c for c in counts), sum(c < 0 for c in counts)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# ---- 2 ----


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 60")
    model = langid.fit_text_model(train)
    none = F.lit(None).cast("string")
    rows = held.select("doc_id", "text", none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"))
    got = langid.identify(rows, model, ("doc_id",)).join(held.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    assert sum(r["lang"] == r["want"] for r in got) / len(got) > 0.97
    assert all(r["kept"] for r in got)


def test_long_texts_score_by_pieces_as_by_whole():
    rng = np.random.default_rng(5)
    lengths = [0, 1, 3, 4, 5, 700, langid.PIECE, langid.PIECE + 3, langid.PIECE + 4, 3 * langid.PIECE + 17, 2, 50]
    raw = rng.integers(0, 256, sum(lengths)).astype(np.uint8)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    model = langid.TextModel(["a", "b"], np.log(rng.random((langid.SLOTS, 3))).astype(np.float32))
    got = model.scores(raw, offsets)
    for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
        grams = [bytes(langid._LOWER[raw[i : i + langid.GRAM]]) for i in range(a, b - langid.GRAM + 1)]
        slots = [(int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> 16 for g in grams]
        want = model.table[slots].sum(axis=0, dtype=np.float64) if slots else np.zeros(3)
        assert np.allclose(got[k], want * langid.TEMPER)


def test_declaration_and_host_decide_where_text_cannot(spark):
    rng = random.Random(1)
    fr, en = ["le chat noir dort dans la maison", "une belle journée pour les enfants"], ["the black cat sleeps in the house", "a fine day for all the children"]
    model = langid.fit_text_model(spark.createDataFrame([(t + f" {k}", l) for l, ts in (("fr", fr), ("en", en)) for t in ts for k in range(30)], "text string, lang string"))
    rows = [(k, rng.choice(fr), "fr", "a.fr", "fr") for k in range(50)] + [(k, rng.choice(en), "en", "b.com", "com") for k in range(50, 100)]
    rows += [(100, "x", "fr", "a.fr", "fr"), (101, "x", None, "b.com", "com"), (102, None, "en", None, None), (103, "12 34", "en", "b.com", "com"), (104, "Это совсем другой язык, и письмо другое", None, None, None)]
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r["id"]: r for r in langid.identify(table, model, ("id",)).collect()}
    assert got[100]["lang"] == "fr" and got[101]["lang"] == "en"
    assert not got[102]["kept"] and not got[103]["kept"] and got[102]["lang"] == "und"
    assert got[104]["lang"] == "und" and not got[104]["kept"]


def test_rare_labels_are_languages_whatever_the_size_of_the_table(spark):
    en, el = "the black cat sleeps in the house and number {} runs", "η μαύρη γάτα κοιμάται μέσα στο σπίτι και η {} τρέχει"
    rows = [(en.format(k % 400 if k < 3000 else 0), "en") for k in range(6000)] + [(en.format(k), None) for k in range(6000)]  # half are one text
    rows += [(el.format(k), "el") for k in range(3)] + [("это длинный текст на другом языке " * 4000, "ru")]
    table = spark.createDataFrame(rows, "text string, lang string")
    langs, sample = langid.label_sample(table, "text", "lang", 200)
    got = sample.collect()
    assert langs == ["el", "en", "ru"] and len(set(got)) == len(got)
    assert [sum(r["lang"] == x for r in got) for x in langs] == [3, 66, 1]
    least = sorted((r["h"], r["text"]) for r in table.where("lang = 'en'").select("text", F.xxhash64("text").alias("h")).distinct().collect())[:66]
    assert {t for _, t in least} == {r["text"] for r in got if r["lang"] == "en"}
    model = langid.fit_text_model(table, sample_rows=200)
    new = spark.createDataFrame([(1, el.format("άσπρη"))], "id long, text string").selectExpr("id", "text", *[f"cast(null as string) as {c}" for c in ("declared", "host", "suffix")])
    told = langid.identify(new, model, ("id",)).first()
    assert told["lang"] == "el" and told["kept"]


def test_evidence_of_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" lang=\'de-AT\'><script>var a = "</p>";</script><p>Guten <b>Tag</b><!-- x --></p>'
    pages = spark.createDataFrame([(1, "https://user@Shop.Example.de:8080/x?y", html), (2, None, None), (3, "bad", "")], "page_id long, url string, html string")
    got = pages.select("page_id", *langid.evidence_of_pages(pages)).orderBy("page_id").collect()
    assert (got[0]["declared"], got[0]["host"], got[0]["suffix"]) == ("de", "shop.example.de", "de") and got[0]["text"].split() == ["Guten", "Tag"]
    assert got[1]["host"] is None and got[2]["declared"] is None


# ---- 3 ----


def word_set(text):
    lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_force(rows):
    sets = {r["doc_id"]: word_set(r["text"]) for r in rows if r["doc_id"] is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_near_duplicates(corpus, odd):
    for table in (corpus, odd):
        rows = table.select("doc_id", "text").collect()
        want = components_by_force(rows)
        got = neardup.near_duplicates(table).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_chains_that_the_smallest_member_does_not_link(spark, docs_of):
    """Each text is near the next only, and their ids run so that a bucket's smallest member misses most."""
    rng = random.Random(5)
    words = [rng.choice(WORDS) + str(k) for k in range(120)]
    texts = []
    for k in range(40):
        words = words[:]
        words[(k * 7) % 120 : (k * 7) % 120 + 3] = [f"new{k}a", f"new{k}b", f"new{k}c"]
        texts.append(" ".join(words))
    order = list(range(40))
    rng.shuffle(order)
    table = docs_of([(order[k], t, "en", "s", 0) for k, t in enumerate(texts)])
    want = components_by_force(table.collect())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table).collect()} == want
    assert len({c for _, c in want.values()}) == 1


def test_block_pairs_compares_every_pair_that_shares_a_bucket():
    """Every bucket as a table of its own: the pairs that come out, once each, are those that
    share a bucket key and whose signatures are not given up."""
    rng = np.random.default_rng(3)
    universe = rng.integers(0, 1 << 62, 200_000, np.uint64)
    sets = []
    for k in range(0, 60_000, 300):  # three near copies of one set each
        own = universe[k : k + 300]
        sets += [np.unique(np.concatenate([own[: 300 - cut], universe[100_000 + k + c * 20 : 100_000 + k + c * 20 + cut]])) for c, cut in enumerate((0, 20, 40))]
    sets = sets * 4
    sets = [np.unique(s * np.uint64(2 * (n // 600) + 1)) for n, s in enumerate(sets)]  # other hashes, other signatures
    signs, bands = shingles.signatures(sets)
    shared, masked = set(), 0
    n = len(sets)
    for k in range(n):
        for m in range(k + 1, min(n, k // 3 * 3 + 3)):
            same = np.flatnonzero(bands[k] == bands[m])
            if len(same) and len(neardup.survivors(signs[[k]], signs[[m]], 0.75)):
                shared.add((k, m))
                low = (signs[k, :128] == signs[m, :128]).reshape(32, 4).all(axis=1)
                masked += low[: same[0]].any()
    assert masked > 0  # some have an earlier band with equal low bytes and different keys
    got = []
    for band in range(shingles.BANDS):
        order = np.argsort(bands[:, band], kind="stable")
        key = bands[order, band]
        zeros = pa.array(np.zeros(n, np.int32))
        part = pa.RecordBatch.from_arrays(
            [pa.array(key), zeros, zeros, pa.array(order), pa.array(order), zeros, pa.array(np.full(n, band, np.int32)),
             pa.array([signs[k].tobytes() for k in order], pa.binary()), pa.array([bands[k, :band].tolist() for k in order], pa.list_(pa.int64()))],
            names=["bucket", "i", "j", "node", "root", "block", "band", "signature", "earlier"],
        )
        for cut in (part.slice(0, n // 2), part.slice(n // 2)), :
            for out in neardup._block_pairs(75)(iter(cut)):
                got += zip(out.column(0).to_pylist(), out.column(1).to_pylist())
    assert len(got) == len(set(got)) and set(got) >= shared


def test_pruning_bounds_keep_pairs_at_the_threshold():
    bounds = neardup.least_matches(0.75, 1e-5, 64)
    assert [k for k, _ in bounds] == list(range(64, 769, 64))
    assert all(m < 0.75 * k for k, m in bounds) and bounds[-1][1] > 0.66 * 768


def test_one_id_with_two_texts(docs_of):
    rng = random.Random(8)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (7, a, "en", "s", 0), (8, b, "en", "s", 0), (9, b + " end", "en", "s", 0), (5, c, "en", "s", 0), (5, c + " end", "en", "s", 0)]
    got = neardup.near_duplicates(docs_of(rows)).collect()
    classes = defaultdict(list)
    for r in got:
        classes[r["class_id"]].append(r["doc_id"])
        assert r["component_id"] == 5 and r["kept"] == (r["doc_id"] == 5)
    assert sorted(map(sorted, classes.values())) == [[5, 5], [5, 7], [5, 8, 9]]


# ---- 4 ----


def spread_by_force(rows, min_sites, min_chars):
    def key(line):
        return line.strip(" ") if len(line.strip(" ")) >= min_chars else None

    def spread(lines, texts):
        sites = defaultdict(set)
        for r in texts:
            for line in r["text"].split("\n"):
                if key(line) in lines or (lines is ALL and key(line)):
                    sites[key(line)].add(r["source"] or "")
        return {k for k, v in sites.items() if len(v) >= min_sites}

    ALL = frozenset()
    texts = [r for r in rows if r["text"] is not None]
    candidates = spread(ALL, texts)
    size = lambda t: sum(len(x.encode()) for x in t.split("\n") if key(x) in candidates)
    found = spread(candidates, [r for r in texts if 2 * size(r["text"]) <= len(r["text"].encode())]) if candidates else set()
    out = []
    for r in rows:
        lines = [] if r["text"] is None else r["text"].split("\n")
        kept = [x for x in lines if key(x) is None or key(x) not in found]
        out.append((r["doc_id"], None if r["text"] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_pages_of_mostly_boilerplate_are_cut_and_copies_are_not(docs_of):
    rng = random.Random(1)
    footer, article = prose(rng, 6), "\n".join(prose(rng, 9) for _ in range(5))
    rows = [(k, f"{prose(rng, 30)}\n{footer}", "en", f"s{k % 15}", 0) for k in range(60)]
    rows += [(100 + k, f"{footer}\nown {k}", "en", f"s{k}", 0) for k in range(5)] + [(200 + k, article, "en", f"s{k % 20}", 0) for k in range(50)]
    got = {r["doc_id"]: r["text"] for r in linespread.remove_boilerplate(docs_of(rows)).collect()}
    assert all("\n" not in got[k] for k in range(60))
    assert [got[100 + k] for k in range(5)] == [f"own {k}" for k in range(5)]
    assert {got[200 + k] for k in range(50)} == {article}


@pytest.mark.parametrize("min_sites", [3, 12, 40])
def test_line_spread(spark, docs_of, odd, min_sites):
    rng = random.Random(min_sites)
    shared = [prose(rng, 5) for _ in range(12)]
    rows = []
    for k in range(400):
        lines = [prose(rng, 8) for _ in range(4)] + [s for j, s in enumerate(shared) if rng.random() < 0.02 * (j + 1)]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", f"site{rng.randrange(60)}", 0))
    rows.append((400, f"{shared[11]}\n{shared[11]}", "en", "site1", 0))  # nothing but boilerplate
    rows += [(500 + k, "\n".join(shared[:4]) + "\nand the rest", "en", f"site{k}", 0) for k in range(45)]  # copies
    for table in (docs_of(rows), odd):
        got = linespread.remove_boilerplate(table, min_sites=min_sites)
        assert got.columns[: len(table.columns)] == table.columns
        want = spread_by_force(table.collect(), min_sites, linespread.MIN_CHARS)
        assert sorted(map(str, got.select("doc_id", "text", "n_lines", "n_removed").toPandas().astype(str).values.tolist())) == sorted(
            map(str, spark.createDataFrame(want, "doc_id long, text string, n_lines long, n_removed long").toPandas().astype(str).values.tolist())
        )


# ---- 5 ----


def repeats_by_force(rows):
    first = {}
    for r in rows:
        b = (r["text"] or "").encode()
        if r["doc_id"] is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(first.get(w, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        if r["doc_id"] is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < r["doc_id"]:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r["doc_id"], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("division", [{}, {"bundle_least": 2000, "block_bytes": 3000}, {"bundle_least": 500, "block_bytes": 20_000, "crowd": 2}])
def test_repeats(corpus, odd, docs_of, division):
    rng = random.Random(9)
    small = [("ab" * 40)[: rng.randint(40, 80)] for _ in range(20)] + ["x" * k for k in (49, 50, 51, 120)] + [prose(rng, 30)[k : k + 90] for k in range(0, 60, 7)]
    periodic = docs_of([(rng.randrange(1000), t, "en", "s", 0) for t in small + small])
    licence = prose(rng, 25)
    common = docs_of([(rng.randrange(300), prose(rng, rng.randint(0, 8)) + licence[rng.randint(0, 9) :] + prose(rng, rng.randint(0, 8)), "en", "s", 0) for _ in range(300)])
    for table in (corpus, odd, periodic, common):
        rows = table.select("doc_id", "text").collect()
        assert sorted(str(tuple(r)) for r in repeats.remove_repeats(table, **division).collect()) == repeats_by_force(rows)


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(40):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        suffixes = sorted((t[k:], d, k) for d, t in enumerate(texts) for k in range(len(t)))
        both = [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(suffixes, suffixes[1:])]
        want = [max([len(os.path.commonprefix([s, t[j:]])) for t in texts[:d] for j in range(len(t))], default=0) for s, d, _ in suffixes]
        got = repeats.longest_previous(np.array([d for _, d, _ in suffixes], np.int64), np.array([0, *both][: len(suffixes)], np.int32))
        assert got.tolist() == want


def test_kept_bytes(docs_of):
    text = "the passage that both of them have, longer than fifty bytes in all"
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs_of([(2, "b " + text + " c", "en", "s", 0), (1, text, "en", "s", 0)]), keep_text=True).collect()}
    assert got == {1: text.encode(), 2: b"b  c"}


# ---- 6 ----


def tokens(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingle_set(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_contamination(spark, corpus, odd):
    rng = random.Random(4)
    texts = [r["text"] for r in corpus.take(30)]
    items = [(k, " ".join(t.split()[3 : 3 + rng.randint(2, 40)])) for k, t in enumerate(texts)]
    items += [(k + 100, " ".join(w if rng.random() > 0.04 else "zzz" for w in t.split())) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, "one two"), (None, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for table in (corpus, odd):
        want = []
        for r in table.collect():
            s = shingle_set(r["text"])
            for i, t in items:
                q = shingle_set(t)
                if q and len(q & s) >= 0.75 * len(q):
                    want.append((r["doc_id"], i, len(q), len(q & s)))
        got = contamination.find_contaminated(table, bench).drop("text_key").collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and want
        left = contamination.drop_contaminated(table, bench)
        assert left.columns == table.columns and left.count() == table.count() - len({(w[0]) for w in want if w[0] != 9}) - 2 * any(w[0] == 9 for w in want)


# ---- 7 ----


def test_bpe_equals_the_library(corpus, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    for table in (corpus, odd):
        name = lexicon.build_lexicon(table, BPE, size=50)
        got = lexicon.encode_decode(table, BPE, name, arrays=True).collect()
        want = []
        for r in table.collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            text = t.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
        assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_merges_equal_the_library():
    from tokenizers import Tokenizer

    t, pairs = Tokenizer.from_file(BPE), lexicon.WordPairs(BPE)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 60))) for _ in range(2000)] + ["aaaa" * k for k in range(1, 40)]
    words.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)))
    want = [t.encode(w, add_special_tokens=False).ids for w in words]
    assert pairs.merge_many(words) == want
    assert [pairs.merge(w) for w in words] == want
    for text in ("a<|startoftext|>b <|endoftext|>", "".join(map(chr, range(1, 0x300))), "İ ª µ º ǅ x\x85y\xa0z\x1cq K Å ſt", "\ua7cb \U00010d50 \U00016eb8"):
        assert [i for ids in pairs.merge_many(pairs.words(text)) for i in ids] == t.encode(text, add_special_tokens=False).ids


def test_transducer_holds_exactly_its_words(tmp_path):
    rng = random.Random(2)
    entries = {"".join(rng.choices("abc", k=rng.randint(1, 7))).encode(): [rng.randrange(1000) for _ in range(rng.randint(0, 4))] for _ in range(300)}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compile_transducer(entries))
    t = lexicon.Transducer(str(path))
    probes = list(entries) + [w + b"a" for w in entries] + [b"", b"zz"]
    for w, k in zip(probes, t.places(probes).tolist()):
        assert (k >= 0) == (w in entries) and (k < 0 or t.ids_at(k) == entries[w])
    assert len(t.final) < sum(map(len, entries))  # suffixes are shared


# ---- 8 ----


def test_media(corpus, odd):
    for table in (corpus, odd):
        got = media.media_column(table).collect()
        want = []
        for r in table.collect():
            b = (r["text"] or "").encode()
            p = b + bytes(-len(b) % 64) or bytes(64)
            image = media.encode_image(b)
            samples, n = media.decode_image(image)
            assert samples.tobytes() == p and n == len(b)
            want.append((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.feature_of(samples)))
        assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_byte_ranges_take_each_member_once(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.pack_media(corpus, path)
    for n in (1000, 5000, 10**9):
        got = media.read_media(spark, path, range_bytes=n)
        assert got.count() == corpus.count()


def test_members_are_retried_alone(tmp_path):
    path = tmp_path / "a.zip"
    with path.open("wb") as f:
        a = media.ArchiveFile(f)
        a.add(b"one", b"1" * 100)
        a.add(b"two", b"2" * 100)
        size = a.close()

    class Flaky:
        opened = 0

        def open_input_file(self, p):
            Flaky.opened += 1
            if Flaky.opened == 1:
                raise OSError("lost")
            return open(p, "rb")

    with path.open("rb") as f:
        members = media.directory_of(f, size)
    held = []
    assert [media.read_member(Flaky(), str(path), *m[1:], held) for m in members] == [b"1" * 100, b"2" * 100] and Flaky.opened == 2
    with pytest.raises(media.MemberError):
        media.read_member(Flaky(), str(path), members[0][1], 100, 12345, [], attempts=2)
    for f in held:
        f.close()


def test_archives_cut_short_are_member_errors(tmp_path):
    path = tmp_path / "a.zip"
    archive = media.ArchiveFile(path.open("wb"))
    for name in (b"1", b"2"):
        archive.add(name, name * 100)
    archive.close()
    whole = path.read_bytes()
    with path.open("rb") as f:
        members = media.directory_of(f, len(whole))
    short = tmp_path / "short.zip"

    class Short:
        def open_input_file(self, _):
            return short.open("rb")

    for n in (0, 3, 29, 60, members[1][1] + 10):  # within heads and contents
        short.write_bytes(whole[:n])
        with pytest.raises(media.MemberError):
            media.read_member(Short(), "short.zip", *members[n > 140][1:], [], attempts=1)
    for n in (22, 60, len(whole) - 1):
        short.write_bytes(whole[:n])
        with short.open("rb") as f, pytest.raises(media.MemberError):
            media.directory_of(f, n)
    short.write_bytes(whole[:-60] + whole[-40:])  # a directory that ends within an entry
    with short.open("rb") as f, pytest.raises(media.MemberError):
        media.directory_of(f, len(whole) - 20)


def test_damaged_image():
    image = bytearray(media.encode_image(b"abc"))
    image[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_image(bytes(image))


# ---- 9 ----

PRIVATE = [
    "Write to Jane.Doe+x@mail.example.org today", "jane.doe+x@MAIL.example.org again", "call +1 (017) 555-7713 or (212) 555-0000", "card 4111 1111 1111 1111, also 4111-1111-1111-1111",
    "ip 10.0.0.1 and 110.0.0.11.", 'token = "24be64439e49cf46b2d7c90f3602a3d0b907ff24"', "SSN 078-05-1120", "IBAN DE89 3704 0044 0532 0130 00", "Frau Anna Schmidt met Mr. Jones and Mrs. Jones", "Госпожа Иванова",
    "version 2.0 of 12 things in 2024", "nothing here",
]


def test_surrogates(spark, docs_of, odd):
    table = docs_of([(k, t, "en", "s", 0) for k, t in enumerate(PRIVATE)])
    got = {r["doc_id"]: r for r in surrogates.replace_personal_data(table, "key").collect()}
    text = {k: r["text"] for k, r in got.items()}
    for secret in ("Jane", "doe", "555-7713", "555-0000", "4111", "24be64439e", "078-05", "3704", "Schmidt", "Jones", "Иванов"):
        assert secret not in " ".join(text.values()), secret
    assert "10.0.0.1 " not in text[4] and text[4].endswith(".")
    a, b = re.findall(r"\S+@\S+", text[0])[0], re.findall(r"\S+@\S+", text[1])[0]
    assert a.lower() == b.lower() and a.endswith(".org")  # one entity, one surrogate
    x, y = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", text[3])
    assert x.replace(" ", "") == y.replace("-", "") and " " in x and "-" in y  # format kept
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', text[5]) and re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}", text[6]) and text[7].startswith("IBAN DE")
    assert re.fullmatch(r"Frau (\w+) \w+ met Mr\. (\w+) and Mrs\. \w+", text[8])
    assert re.match(r"Frau (\w+)", text[8])[1] in surrogates.GIVEN["latin", "f"]
    assert re.fullmatch("Госпожа [А-Я][а-я]+", text[9])
    assert text[10] == PRIVATE[10] and text[11] == PRIVATE[11] and got[11]["n_entities"] == 0
    assert surrogates.replace_personal_data(table, "other").where("doc_id = 0").first()["text"] != text[0]
    out = surrogates.replace_personal_data(odd, "key")
    assert out.count() == odd.count() and out.columns[:-1] == odd.columns


def mentions_by_force(text):
    """(kind, mention) pairs, and the text between them, by each pattern at each place in order."""
    import regex

    plain = "|".join(f"(?P<{k}>{p if k == 'name' else '(?a:' + p + ')'})" for k, p in surrogates.PATTERNS.items())
    found, between, last = [], [], 0
    for m in regex.finditer(plain, text):
        found.append((m.lastgroup, m[0]))
        between.append(text[last : m.start()])
        last = m.end()
    return found, [*between, text[last:]]


def entity_of(kind, mention):
    if kind in ("ip", "email"):
        return mention.lower()
    return mention.split(" ", 1)[1].lower() if kind == "name" else "".join(c for c in mention if c.isalnum()).lower()


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_surrogates_by_force(docs_of, odd, corpus):
    """Every mention that plain matching finds is replaced, nothing else is; entities corefer and stay distinct."""
    more = [
        "IBAN AB12CDEFGHIJKLMN only", "Dr Παπαδόπουλος", "Mr Վարդանյան here", "hex " + "abcdefab" * 4, "card 4111 1111 1111 1111", "IBAN GB82 WEST 1234 5698 7654 32", "", None,
        *[f"write to {x}@{y}.co or call +49 30 {k}{k} {k}001" for k, (x, y) in enumerate(zip("abcdefgh", "qrstuvwx"), 10)],
    ]
    for table in (docs_of([(k, t, "en", "s", 0) for k, t in enumerate([*PRIVATE, *more])]), odd, corpus):
        key = lambda r: (str(r["doc_id"]), r["source"] or "", r["text"] is None, "")
        before = sorted(table.collect(), key=key)
        after = sorted(surrogates.replace_personal_data(table, DEMO_KEY).collect(), key=key)
        new = {}
        for r, s in zip(before, after):
            if r["text"] is None:
                assert s["text"] is None and s["n_entities"] == 0
                continue
            found, between = mentions_by_force(r["text"])
            assert s["n_entities"] == len(found)
            if not found:
                assert s["text"] == r["text"]
                continue
            whole = re.fullmatch("(.+?)".join(map(re.escape, between)), s["text"], re.S)
            assert whole
            for (kind, mention), said in zip(found, whole.groups()):
                entity, other = entity_of(kind, mention), entity_of(kind, said)
                assert new.setdefault((kind, entity), other) == other != entity
                shape = [re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", x)) for x in (mention, said)]
                assert kind in ("name", "secret", "ip") or shape[1] == shape[0]
                if kind == "card":
                    assert luhn(re.sub(r"\D", "", said))
                if kind == "iban":
                    plain = said.replace(" ", "")
                    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        assert len(set(new.items())) == len({(k, v) for (k, _), v in new.items()})
        assert not {(k, v) for (k, _), v in new.items()} & set(new)


def test_surrogates_keep_the_script(docs_of):
    rows = [(1, "Dr Παπαδόπουλος", "el", "s", 0), (2, "Mr Վարդանյան", "hy", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_personal_data(docs_of(rows), DEMO_KEY).collect()}
    assert re.fullmatch("Dr [Α-Ω][α-ωά-ώ]+", got[1]) and re.fullmatch("Mr [Ա-Ֆ][ա-ֆ]+", got[2])


def test_short_forms_never_run_out(spark):
    rows = [(f"{a}@{b}.co",) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = surrogates.surrogate_table(spark.createDataFrame(rows, "mention string"), DEMO_KEY).collect()
    assert len(got) == 676 == len({r["replacement"] for r in got}) and not {r["replacement"] for r in got} & {m for (m,) in rows}
    assert all(re.fullmatch(r"[a-z]{2,}@[a-z]\.co", r["replacement"]) for r in got)


def test_the_key_is_not_in_the_plan(docs_of, capsys):
    key = "a-secret-key-of-mine"
    surrogates.replace_personal_data(docs_of([(1, "a@b.co", "en", "s", 0)]), key).explain("extended")
    mentions = docs_of([(1, "a@b.co", "en", "s", 0)]).select(F.col("text").alias("mention"))
    surrogates.surrogate_table(mentions, key).explain("extended")
    assert key not in capsys.readouterr().out
    import hmac

    inner, outer = surrogates._pads(key)
    row = mentions.select(F.lit(bytearray(inner)).alias("inner"), F.lit(bytearray(outer)).alias("outer"), surrogates._stream(F.lit("m")).alias("x")).first()
    assert row["x"][:64] == hmac.new(key.encode(), b"m|0", "sha256").hexdigest()


def test_surrogates_stay_distinct(spark):
    rows = [(f"Mr {a}{b}",) for a in "ABCDEFGH" for b in ("adler", "becker", "conrad", "dorn", "engel", "falk")] + [(f"{k}.{k}.0.1",) for k in range(256)] + [(f"{k:03d}-11-2222",) for k in range(900)]
    got = surrogates.surrogate_table(spark.createDataFrame(rows, "mention string"), DEMO_KEY).collect()
    assert len(got) == len(rows) == len({(r["kind"], r["surrogate"]) for r in got})
    real = {(r["kind"], r["entity"]) for r in got}
    assert not any((r["kind"], r["surrogate"]) in real for r in got)


# ---- 10 ----


@pytest.mark.parametrize("bucket", [1 << 24, 3000])
def test_shards(spark, corpus, odd, bucket):
    for table in (corpus, odd):
        n = table.count()
        got = sharding.sharded(table, bucket_bytes=bucket).collect()
        assert len(got) == n
        want = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in table.collect())
        assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots[k]) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1


def test_written_shards(spark, corpus, tmp_path):
    sharding.write_shards(corpus, str(tmp_path / "out"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(corpus.columns).collect())) == sorted(map(str, corpus.collect()))
    assert back.select("_shard").distinct().count() == 3
    again = sharding.shuffle_into_shards(corpus, 3, payload=("doc_id", "text")).select("record.doc_id", "record.text", "shard", "slot")
    assert sorted(map(str, again.collect())) == sorted(map(str, back.select("doc_id", "text", F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).collect()))


# ---- all ----


def test_empty_tables(spark, docs_of):
    empty = docs_of([])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tokencount.count_tokens(empty, PIECES).count() == 0
    model = langid.fit_text_model(empty)
    assert langid.identify(empty.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.col("source").alias("suffix")), model, ("doc_id",)).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert linespread.remove_boilerplate(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert contamination.find_contaminated(empty, bench).count() == 0
    assert lexicon.encode_decode(empty, BPE, lexicon.build_lexicon(empty, BPE)).count() == 0
    assert media.media_column(empty).count() == 0
    assert surrogates.replace_personal_data(empty, "k").count() == 0
    assert sharding.sharded(empty).count() == 0
    assert sharding.shuffle_into_shards(empty).count() == 0
