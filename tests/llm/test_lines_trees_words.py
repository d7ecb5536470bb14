"""Line dedup, Merkle manifests and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketspark.llm import line_dedup, merkle, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- common lines


def plain_lines(rows, least, min_length=1):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOW) for x in (t or "").split("\n")] for _, t in rows]
    held = Counter(k for found in keys for k in set(found) if len(k) >= min_length)
    out = []
    for (i, t), found in zip(rows, keys):
        stay = [x for x, k in zip((t or "").split("\n"), found) if held[k] < least]
        out.append((i, "\n".join(stay), len(found), len(found) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [100_000, 40, 1])
def test_lines_equal_brute_force(spark, odd_docs, monkeypatch, heavy):
    """With few heavy lines allowed, the others take the shuffled way."""
    monkeypatch.setattr(line_dedup, "HEAVY_LINES", heavy)
    rng = random.Random(heavy)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    pool = [f"line {k} of the pool" for k in range(60)]
    for i in range(100, 220):
        lines = [rng.choice(["", " \t", " ALL Share this\r", "\tall share this", f"own {i}", "é" * 3, rng.choice(pool)]) for _ in range(rng.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(300, "a\nb\nall share this")] * 12 + [(None, "a\n\nx")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least, length in ((10, 1), (3, 4)):
        got = line_dedup.without_common_lines(df, min_documents=least, min_length=length)
        assert rows_of(got.select("doc_id", "text", "n_lines", "n_dropped")) == plain_lines(rows, least, length)


def test_lines_keep_other_columns(odd_docs, no_docs):
    clash = odd_docs.withColumnsRenamed({"score": "n_lines", "label": "_gone"}).withColumn("t1", F.lit("x"))
    got = line_dedup.without_common_lines(clash, min_documents=2)
    assert got.columns == [*clash.columns, "n_lines_", "n_dropped"]
    assert sorted(map(str, got.select("n_lines", "_gone", "t1", "n_chars").collect())) == sorted(map(str, clash.select("n_lines", "_gone", "t1", "n_chars").collect()))
    assert {r.n_dropped for r in got.where("doc_id = 1").collect()} == {1}
    assert line_dedup.without_common_lines(no_docs).count() == 0


def test_heavy_lines_are_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot\n"), (F.col("id") % 200).cast("string")).alias("text"))
    common = line_dedup.common_lines(df)
    assert common.count() == 201 and common.where("heavy").count() <= line_dedup.HEAVY_LINES


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(leaves):
    """Root, and per leaf the (before, after) siblings of each level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            s = p - p % 16
            paths[k].append(("".join(level[s:p]), "".join(level[p + 1:s + 16])))
            at[k] = p // 16
        level = [sha("".join(level[s:s + 16])) for s in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["" if r["source"] is None else "=" + r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    order = sorted(groups, key=str.encode)
    trees = {k: plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order}
    root, above = plain_tree([trees[k][0] for k in order])
    out = []
    for g, k in enumerate(order):
        for (_, _, leaf, r), path in zip(sorted(groups[k], key=lambda x: x[:3]), trees[k][1]):
            path, i = path + above[g], r["doc_id"]
            changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            folded = plain_leaf(r, r["text"].translate(LOW) if r["text"] is not None else None) if changed else leaf
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((i, leaf, trees[k][0], root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=repr)


def check_manifest(df):
    rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    manifest = merkle.build_manifest(df, changed=merkle.tampered_case(df))
    want = plain_manifest(rows)
    assert rows_of(merkle.verify(manifest)) == want
    assert manifest.root == want[0][3]
    return manifest


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 1, 16, 5], [1] * 40, [260] + [1] * 18])
def test_manifest_equals_brute_force(spark, sizes):
    rows, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            i += 1
            rows.append((i * 37 % 1009, None if s == 1 else f"s{s:02d}É", "en", i, f"Text number {i} É"))
    check_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_manifest_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(merkle, "COPY_LEAVES", 3)  # many copies of the upper nodes
    more = spark.range(700).selectExpr("id AS doc_id", "'Some TEXT' AS text", "'en' AS lang", "if(id % 3 = 0, 'hot', concat('x', id % 60)) AS source", "id AS n_chars", "'k' AS score", "0D AS label")
    manifest = check_manifest(odd_docs.unionByName(more).withColumns({"key": F.lit(1), "node": F.lit("x"), "digest": F.lit(None)}))
    assert manifest.nodes.where("copy > 0").count() > 0
    empty = merkle.build_manifest(no_docs)
    assert merkle.verify(empty).count() == 0 and empty.root is None


def test_changed_rows_do_not_verify(spark, odd_docs):
    docs = odd_docs.where("doc_id IN (5, 6, 8)")
    told = merkle.verify(merkle.build_manifest(docs, changed=F.when(F.col("doc_id") == 6, F.sha2(F.lit("x"), 256))))
    assert {r.id: r.verified for r in told.collect()} == {5: True, 6: False, 8: True}


# --- spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    form, out = {}, []
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if near and words[best] >= 5 * words[w] else None
        out.append([w, words[w], len(near), form[w], words.get(form[w])])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out), key=repr)


def test_variants_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(3)
    base = ["spelling", "variant", "naïveté", "straßen", "aabbaabb", "mississippi", "abcdefg", "é" * 7]
    words = list(base)
    for w in base * 30:
        k, c = rng.randrange(len(w) + 1), rng.choice("abeéÿ")
        words.append(rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:]]))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 10_000]
    for i in range(1500):
        some = [rng.choice(base) if rng.random() < 0.7 else rng.choice(words) for _ in range(12)]
        rows.append((i, rng.choice([" ", "-", "×", " 日本", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in some)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variant_groups(df).select("word", "n", "n_near", "form", "form_n", "root")
    want = plain_variants(rows)
    assert rows_of(got) == want and sum(r[3] is not None for r in want) > 20
    assert any(r[5] not in (r[0], r[3]) for r in want) or any(r[3] for r in want)
    assert spelling.variant_groups(no_docs).count() == 0


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"chainab": 5, "chainabc": 30, "chainabcd": 200}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    got = {r.word: (r.form, r.root) for r in spelling.variant_groups(spark.createDataFrame(rows, "doc_id long, text string"), min_count=5).collect()}
    assert got == {"chainab": ("chainabc", "chainabcd"), "chainabc": ("chainabcd", "chainabcd"), "chainabcd": (None, "chainabcd")}


def test_long_words_meet(spark):
    """Words around and far beyond the length that is hashed find each other by every edit."""
    rng = random.Random(9)
    rows, k = [], 0
    for size in (62, 63, 64, 65, 66, 67, 300, 5000):
        word = "".join(rng.choice("abcé") for _ in range(size))
        at = rng.randrange(1, size)
        for w, n in ((word, 60), (word[:at] + word[at + 1:], 6), (word[:at] + "z" + word[at:], 7), (word[:at] + "x" + word[at + 1:], 8), (word + "y", 5), (word[1:], 5)):
            k += 1
            rows.append((k, " ".join([w] * n)))
    got = spelling.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("word", "n", "n_near", "form", "form_n", "root")
    assert rows_of(got) == plain_variants(rows)


def test_a_group_of_rotations_is_bounded_by_the_alphabet(spark):
    words = [f"{a}bcdefg" for a in "abcdefghijklmnopqrstuvwxyzàáâãäå"] + ["bcdefg"]
    df = spark.createDataFrame([(1, " ".join(w for w in words for _ in range(6)))], "doc_id long, text string")
    got = {r.word: r.n_near for r in spelling.variant_groups(df).collect()}
    want = plain_words([(1, " ".join(w for w in words for _ in range(6)))])
    assert got == {w: sum(one_edit(w, v) for v in want) for w in want}
