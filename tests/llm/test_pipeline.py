import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemill.llm.language import learn, predicted, remainder
from tidemill.llm.mixing import DOCUMENT_BLOCK, mixed_counts
from tidemill.llm.oracles import ORACLES
from tidemill.llm.quality_rules import judged
from tests_brute import shingle_sets_link


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now = docs.columns, docs
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        now.count()
        outs.append(now)
    assert all(o.columns == columns for o in outs[:-1])
    # quality
    want = {r.doc_id: j[10] for r in docs.collect() if (j := judged(r.text, 50))[6]}
    got = {r.doc_id: r.text for r in outs[0].collect()}
    assert got == want
    # the same by SQL, which shares no code but the rules' patterns: who stays, and how many lines with a word are left
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    judged_by_sql = con.execute(f"select doc_id, n_lines - lost_lines from ({ORACLES['op7_line_quality']}) where kept").fetchall()
    assert {d: sum(bool(x.encode().split()) for x in t.split("\n")) for d, t in got.items()} == dict(judged_by_sql)
    whole = {r.doc_id: r.text for r in docs.collect()}
    for d, t in got.items():
        lines = iter(whole[d].split("\n"))
        assert all(line in lines for line in t.split("\n")), d  # in their order
    # language
    trees = learn(outs[0].where(remainder() != 0))
    rows = outs[0].orderBy("doc_id").collect()
    kept = {r.doc_id for r, (lang, score) in zip(rows, predicted(trees, [r.text for r in rows])) if lang != "und" and score >= 0.5}
    assert {r.doc_id for r in outs[1].collect()} == kept
    # one of each group
    rows = sorted((r.doc_id, r.text) for r in outs[1].collect())
    assert sorted(r.doc_id for r in outs[2].collect()) == shingle_sets_link(rows, 5, 80)
    # mixing: the words taken are those of mixed_counts
    taken = {r.doc_id: r.taken for r in mixed_counts(outs[2], block=DOCUMENT_BLOCK).collect() if r.taken}
    drawn = Counter()
    for r in outs[3].collect():
        drawn[r.doc_id] += len(r.text.encode().split())
    assert dict(drawn) == taken
    # packing: all ids, once
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = Counter((r.doc_id, struct.pack(f"<{len(x) + 1}I", *x, 1)) for r in outs[3].collect() for x in [t.encode(r.text, add_special_tokens=False).ids])
    pieces, placed = defaultdict(list), defaultdict(list)
    for r in outs[4].collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        placed[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    by_doc = defaultdict(list)
    for (d, x), n in ids.items():
        by_doc[d] += [x] * n
    assert set(pieces) == set(by_doc)
    for d, texts in by_doc.items():
        if len(texts) == 1:
            assert b"".join(x for _, x in sorted(pieces[d])) == texts[0], d
        else:  # drawn more than once: each piece is in one of them at its place, and together they are as long
            assert all(any(x[4 * start : 4 * start + len(part)] == part for x in texts) for start, part in pieces[d]), d
            assert sum(len(x) for _, x in pieces[d]) == sum(map(len, texts)), d
    for where in placed.values():
        end = 0
        for offset, length in sorted(where):
            assert offset == end
            end += length
        assert end <= 2048
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == outs[4].columns
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in run.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in outs[4].collect())


def test_odd_and_empty(spark, odd_docs, empty_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("empty", empty_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {None, *range(10)} and (name == "odd" or not ids)
