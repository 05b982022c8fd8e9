"""The registered queries of this subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.bpe import encode_documents
from leadloom.llm.common import stored
from leadloom.llm.compression import bands_of, judged, measure
from leadloom.llm.exact_dedup import exact_groups
from leadloom.llm.html_extract import extract_pages
from leadloom.llm.language import identify, train_languages
from leadloom.llm.license_scan import scan_licenses
from leadloom.llm.manifest import audited
from leadloom.llm.mixing import mix_documents
from leadloom.llm.quality import crc_mod, score_quality, train_quality
from leadloom.llm.simhash import simhash_groups
from leadloom.llm.spelling import spelling_variants
from leadloom.llm.suffix_dedup import remove_repeats
from leadloom.llm.toxicity import score_toxicity, train_toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return scan_licenses(_table(spark, sf_dir, "documents"), findings=False)


def op2_simhash_near_dedup(spark, sf_dir):
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"), kept=False)


def op4_bpe_round_trip(spark, sf_dir):
    return encode_documents(_table(spark, sf_dir, "documents"), VOCABULARY, DIGESTS)


def op5_mix_sources(spark, sf_dir):
    return mix_documents(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= model.at).cast("int").alias("predicted"),
    )


def op7_html_extraction(spark, sf_dir):
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_compression_bands(spark, sf_dir):
    measured = stored(measure(_table(spark, sf_dir, "documents")), "measured")
    return judged(measured, bands_of(measured))


def op9_exact_dedup(spark, sf_dir):
    groups = exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, train_languages(docs))
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "cross_entropy", "rejected")


def op11_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    held_out = (crc_mod("doc_id", 4) == 2).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", (F.col("score") >= model.at).cast("int").alias("predicted"))


def op12_spelling_variants(spark, sf_dir):
    found = spelling_variants(_table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return audited(docs, text=F.when(crc_mod("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text")))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_html_extraction": op7_html_extraction,
    "op8_compression_bands": op8_compression_bands,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: crc32 of the UTF-8 bytes of a text, as SQL: the table of one byte's steps, then a step for each byte.
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(hex(encode({0}))) // 2), lambda i: ('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2])::bigint)),
 lambda c, b: xor(steps[1 + (xor(c, b) & 255)], c >> 8))"""
_CRC_TABLE = """bits(byte, k, v) as (select range, 0, range::bigint from range(256) union all
  select byte, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
 crc as (select list(v order by byte) as steps from bits where k = 8)"""

ORACLES = {
    "op9_exact_dedup": """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
 doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
 from documents window w as (partition by coalesce(text, ''))""",
    "op12_spelling_variants": f"""with recursive {_CRC_TABLE},
 runs as (select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
 counted as (select doc, run, count(*) as n from runs group by all),
 hashed as (select run, n, xor({_CRC.format("doc || ':' || run")}, 4294967295) as h from counted, crc),
 words as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n
  from hashed group by 1 having length(word) >= 6 and sum(n) >= 5),
 shorter as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from (select word, n, unnest(range(length(word))) as i from words)),
 pairs as (select a.word, b.word as other, b.n as other_n from shorter a join shorter b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.v = b.word union select b.word, a.word, a.n from shorter a join words b on a.v = b.word),
 best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by word),
 forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form,
  case when other_n >= 5 * w.n then other_n end as form_n from words w left join best using (word)),
 roots(word, root) as (select word, word from forms union all select r.word, f.form from roots r join forms f on r.root = f.word where f.form is not null)
 select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f
 join (select r.word, r.root from roots r join forms f on r.root = f.word where f.form is null) r on r.word = f.word""",
    "op13_merkle_manifest": f"""with recursive {_CRC_TABLE},
 docs as (select doc_id, source, coalesce('1' || source, '0') as tree, lang, n_chars, text,
  case when xor({_CRC.format("coalesce(doc_id::varchar, '')")}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as other from documents, crc),
 heads as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from docs),
 leaves as (select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
  sha256(head || coalesce(strlen(other) || ':' || other, '-')) as found from heads),
 ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaves),
 nodes(tree, level, place, node, size) as (select tree, 0, place, leaf, count(*) over (partition by tree) from ranked
  union all select tree, level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((size + 2) // 3)
  from nodes where size > 1 group by tree, level, place // 3),
 subroots as (select tree, node as subroot, row_number() over (order by encode(tree)) - 1 as place from nodes where size = 1),
 upper_nodes(level, place, node, size) as (select 0, place, subroot, count(*) over () from subroots
  union all select level + 1, place // 3, sha256(string_agg(node, '' order by place)), any_value((size + 2) // 3)
  from upper_nodes where size > 1 group by level, place // 3),
 lower_runs as (select tree, level, place, coalesce((select string_agg(o.node, '' order by o.place) from nodes o where o.tree = n.tree and o.level = n.level
   and o.place // 3 = n.place // 3 and o.place < n.place), '') as before, coalesce((select string_agg(o.node, '' order by o.place) from nodes o
   where o.tree = n.tree and o.level = n.level and o.place // 3 = n.place // 3 and o.place > n.place), '') as after from nodes n where size > 1),
 upper_runs as (select level, place, coalesce((select string_agg(o.node, '' order by o.place) from upper_nodes o where o.level = n.level
   and o.place // 3 = n.place // 3 and o.place < n.place), '') as before, coalesce((select string_agg(o.node, '' order by o.place) from upper_nodes o
   where o.level = n.level and o.place // 3 = n.place // 3 and o.place > n.place), '') as after from upper_nodes n where size > 1),
 low(doc_id, tree, row_place, leaf, level, place, proof, folded) as (select doc_id, tree, place, leaf, 0, place, '', found from ranked
  union all select w.doc_id, w.tree, w.row_place, w.leaf, w.level + 1, w.place // 3, w.proof || r.before || r.after, sha256(r.before || w.folded || r.after)
  from low w join lower_runs r on r.tree = w.tree and r.level = w.level and r.place = w.place),
 tops as (select *, row_number() over (partition by tree, row_place order by level desc) as last from low),
 high(doc_id, leaf, subroot, level, place, proof, folded) as (select t.doc_id, t.leaf, s.subroot, 0, s.place, t.proof, t.folded
   from tops t join subroots s on s.tree = t.tree where t.last = 1
  union all select w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 3, w.proof || r.before || r.after, sha256(r.before || w.folded || r.after)
  from high w join upper_runs r on r.level = w.level and r.place = w.place),
 root as (select node as root, level from upper_nodes where size = 1)
 select h.doc_id, h.leaf, h.subroot, r.root, sha256(h.proof) as proof_sha256, h.folded as folded_root, h.folded = r.root as verified
 from high h join root r on h.level = r.level""",
}
