"""Every registered query and the whole pipeline over a small folder of tables: SQL where there is some, contract columns by brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from iqlake.llm import html, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghijklé", k=rng.randint(2, 8))) for _ in range(900)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(25, 120)) + (passage if i % 4 == 0 else [])
        texts.append(" ".join(words).capitalize() + ".")
        if i % 5 == 0:
            texts += [texts[-1], " ".join([*words[:7], "changed", *words[8:]]).capitalize() + "."]
    return [*texts, None, "", " \n", "short", "same words " * 40, "| # $ % & " * 12]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(documents())]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    turns = [(c, t, ["user", "assistant"][t % 2], None if t == 5 else f"turn {t} of {c} " * (t + 1)) for c in range(6) for t in range(2 + 3 * c)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    pages = [(k, f"u{k}", x) for k, x in enumerate([None, "", "<nav>no</nav><article><p>Yes, this is it, really.</p></article>", "<p>a</p>" * 50])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    rng = random.Random(3)
    vectors = [(i, [float(x) for x in rng.choices([-0.5, -0.1, 0.1, 0.3, 0.6], k=8)] if i % 41 else None, i % 3 if i % 17 else None) for i in range(320)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    cols, got = rows(queries.queries()[name](spark, folder))
    assert cols == sorted(names)
    assert got == Counter(tuple(dict(zip(names, r))[c] for c in cols) for r in out.fetchall())


def test_op2(spark, folder):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    hard = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", hard), (1, "assistant", hard)]
    want = {}
    for c, turns in convs.items():
        said = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns)).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    got = queries.op2_budgeted_windows(spark, folder).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert len(got) == len(want) and all(r.formatted_chars > r.loss_chars for r in got)


def test_op3_op4_op9(spark, folder):
    texts = dict(enumerate(documents()))
    got = queries.op3_consistent_ring(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in texts.items())
    per = Counter(r.shard for r in got)
    assert set(per) <= set(range(40)) and max(per.values()) - min(per[s] for s in range(40)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(per[s])) for s in per)
    pieces = queries.op4_histogram_packing(spark, folder).collect()
    of, packs = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r.doc_id].append((r.piece, r.start, r.length))
        packs[r.sequence_id].append((r.offset, r.length))
    assert set(of) == set(texts)
    for spans in [*([x[1:] for x in sorted(v)] for v in of.values()), *(sorted(v) for v in packs.values())]:
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    assert all(sum(n for _, n in v) <= 2048 for v in packs.values())
    rows9 = queries.op9_token_matrices(spark, folder).collect()
    assert {d for r in rows9 for d in r.doc_ids} == set(texts)


def test_op5_op7_op10(spark, folder):
    got = queries.op5_relational_lattice(spark, folder).collect()
    assert len(got) == len(documents()) and all(r.lossless for r in got)
    got = queries.op7_tree_scoring(spark, folder).collect()
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter((p.page_id, p.url, html.main_text(p.html), len(html.main_text(p.html))) for p in pages)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(r"""
        WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents)
        SELECT doc_id, coalesce(len(ws), 0), coalesce(length(array_to_string(ws, '')), 0), coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0), coalesce(len(ls) - len(list_distinct(ls)), 0) FROM w""").fetchall()
    got = queries.op10_weak_supervision(spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in got) == Counter(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_pipeline_run(spark, folder):
    """run() is its stages one after another."""
    got = corpus_pipeline.run(spark, folder).collect()
    texts = dict(enumerate(documents()))
    assert {r.doc_id for r in got} < set(texts) and len({(r.doc_id, r.piece) for r in got}) == len(got)
    kept = {r.doc_id for r in queries.op10_weak_supervision(spark, folder).collect() if r.kept}
    assert {r.doc_id for r in got} <= kept
    last = defaultdict(int)
    for i in kept:
        last[texts[i]] = max(last[texts[i]], i)
    assert {r.doc_id for r in got} <= set(last.values())
    assert not re.search("changed", " ".join(texts[r.doc_id] for r in got if any(texts[r.doc_id].replace("changed", "") == t for t in texts.values() if t)))
