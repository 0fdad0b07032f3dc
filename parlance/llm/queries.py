"""Registered queries of the training-data operators, and SQL to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    block_neighbours,
    chat_format,
    decontamination,
    merkle_manifest,
    minhash_dedup,
    periodic_runs,
    piece_codec,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_files,
    warc,
)
from parlance.llm.tables import table

SHARDS = 40
PROBE = "</s>[INST] ok [/INST]"


GOOD = 2


def rated_grade():
    """Grades of the ratings: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, GOOD)


def op1_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality_classifier.fit(documents, table(spark, folder, "labels"), rated_grade())
    scored = quality_classifier.score(documents.select("doc_id", "text"), model, GOOD)
    return scored.select("doc_id", "score", "expected_grade", "tail_probability", "kept")


def op2_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), shingle_words=2, percent=80)


def op3_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.feistel_shards(table(spark, folder, "documents"), SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    written, manifest = token_files.write_token_files(table(spark, folder, "documents"), vocabulary)
    return token_files.read_token_files(spark, written, manifest).withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.remove_repeated(table(spark, folder, "documents"), min_words=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = piece_codec.encode_and_decode(table(spark, folder, "documents").select("doc_id", "text"), model)
    return decoded.select(
        "doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op7_repetition_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.repetition_coverage(table(spark, folder, "documents"))


def op8_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    planned = warc.plan_records(table(spark, folder, "pages"))
    written, manifest = warc.write_archives(planned)
    records = warc.chunk_records(warc.read_chunks(spark, written, manifest))

    def page(name: str):
        return F.regexp_extract(name, "(-?[0-9]+)>$", 1).try_cast("bigint")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"), "whole",
    )


def op9_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = chat_format.fold_events(chat_format.events_from_turns(turns))
    parsed = chat_format.parse(chat_format.render(messages))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")

    def leaf(text):
        return merkle_manifest.digest(merkle_manifest.encoded(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text))

    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    kept = {
        "doc_id": F.col("doc_id"),
        "offered": F.when(altered, leaf(F.replace("text", F.lit("\n"), F.lit("")))),
    }
    found = merkle_manifest.manifest(documents, leaf(F.col("text")), F.col("source"), F.col("doc_id"), kept)
    refolded = merkle_manifest.folded(F.coalesce("offered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.path_digest(F.col("path")).alias("proof_sha256"),
        refolded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def planted_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by checksum of the id, repeats a stretch of its own words to the end."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    step = F.floor(check / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+", -1), lambda x: x != "")
    chosen = documents.select("doc_id", "text", check.alias("check"), step.alias("step"), F.when(check % 10 == 0, words).alias("words"))
    chosen = chosen.withColumn("n", F.size("words")).withColumn("from", F.when(F.col("n") > 0, F.col("step") % F.col("n")))
    chosen = chosen.withColumn("period", 1 + F.floor((F.col("n") - F.col("from")) / (3 + F.col("step") % 8)))
    repeated = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("from") - 1),
        lambda i: F.get("words", (F.col("from") + i % F.col("period")).cast("int")),
    )
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("from").cast("int")), repeated), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_repeats(table(spark, folder, "documents")))
    # The greatest length comes first, then the smallest start, then the smallest period.
    ranked = F.array_max(F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", ranked).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(-1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_block_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return block_neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_piece_transducer": op6_piece_transducer,
    "op7_repetition_coverage": op7_repetition_coverage,
    "op8_warc_chunks": op8_warc_chunks,
    "op9_chat_events": op9_chat_events,
    "op10_winnowing": op10_winnowing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_block_neighbours": op13_block_neighbours,
}

_CHAT_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(role) + length(regexp_replace(role, '[^\\\\<\\[]', '', 'g')) + 3 + 12 + 14
    + length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g')) as chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

_SUBSTRING_SQL = """
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x != '') as w
  from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) as h
  from (select doc_id, w, unnest(range(0, len(w) - 34)) as i from words)
), repeated as (select h from windows group by h having count(*) > 1),
gone as (
  select distinct doc_id, i + k as place
  from (select doc_id, i from windows where h in (select h from repeated)), (select unnest(range(1, 36)) as k)
), removed as (select doc_id, list(place) as gone from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(
    list_filter(w, lambda x, i: not coalesce(list_contains(gone, i), false)), ' ')) as kept_sha256
from words left join removed using (doc_id)
"""

_DEDUP_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \\x09-\\x0D]+'), lambda x: x != '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(
    range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
), shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b using (x)
  where a.doc_id != b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select doc_id, doc_id as other from sets union select r.doc_id, l.b from reach r join links l on l.a = r.other
), roots as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join roots using (doc_id)
"""

_WINNOWING_SQL = """
with cut as (
  select kind, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x != '') as w
  from (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark)
), windows as (
  select distinct id as item_id, n, array_to_string(w[i + 1 : i + n], ' ') as t
  from (select id, w, least(10, len(w)) as n, unnest(range(0, greatest(len(w) - 9, 1))) as i
    from cut where kind = 'b' and len(w) > 0)
), places as (
  select id as doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as t
  from (select id, w, n, unnest(range(0, len(w) - n + 1)) as i from cut, (select distinct n from windows) where kind = 'd')
), hits as (select doc_id, n, i, item_id from places join windows using (n, t)),
covered as (
  select doc_id, count(distinct place) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from hits)) group by doc_id
), named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from cut left join covered on covered.doc_id = id left join named on named.doc_id = id where kind = 'd'
"""

_MERKLE_SQL = """
with recursive parts as (
  select doc_id, source, text, concat(
      coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-')) as head,
    replace(text, chr(10), '') as short,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) as crc
  from documents
), leaves as (
  select doc_id, coalesce('=' || source, '') as s, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    case when crc % 2 = 0 then sha256(head || coalesce(octet_length(encode(short)) || ':' || short, '-')) end as offered from parts
), placed as (
  select *, row_number() over (partition by s order by doc_id, leaf) - 1 as pos, count(*) over (partition by s) as n from leaves
), tree as (
  select s, 0 as level, pos, n, leaf as h from placed
  union all
  select s, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from tree where n > 1
  group by s, level, pos // 3, n
), subroots as (
  select s, level as height, h, row_number() over (order by s) - 1 as pos, count(*) over () as n from tree where n = 1
), crown as (
  select 0 as level, pos, n, h from subroots
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from crown where n > 1
  group by level, pos // 3, n
), steps as (
  select s, 0 as part, level, pos, h from tree where n > 1 union all select '', 1, level, pos, h from crown where n > 1
), sides as (
  select a.s, a.part, a.level, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') as l,
    coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') as r
  from steps a join steps b on a.s = b.s and a.part = b.part and a.level = b.level and a.pos // 3 = b.pos // 3
  group by a.s, a.part, a.level, a.pos
), climb as (
  select p.doc_id, p.leaf, p.s, u.height, u.pos as top, u.h as subroot, 0 as part, 0 as level, p.pos,
    coalesce(p.offered, p.leaf) as h, '' as proof
  from placed p join subroots u on p.s = u.s
  union all
  select c.doc_id, c.leaf, c.s, c.height, c.top, c.subroot,
    case when c.part = 0 and c.level = c.height then 1 else c.part end,
    case when c.part = 0 and c.level = c.height then 0 else c.level + 1 end,
    case when c.part = 0 and c.level = c.height then c.top else c.pos // 3 end,
    case when c.part = 0 and c.level = c.height then c.h else sha256(d.l || c.h || d.r) end,
    case when c.part = 0 and c.level = c.height then c.proof else c.proof || d.l || d.r end
  from climb c left join sides d
    on d.part = c.part and d.level = c.level and d.pos = c.pos and (d.s = c.s or c.part = 1)
  where (c.part = 0 and c.level = c.height) or d.pos is not null
), ended as (
  select *, row_number() over (partition by doc_id, leaf order by part desc, level desc) as k from climb where part = 1
)
select e.doc_id, e.leaf, e.subroot, r.h as root, sha256(e.proof) as proof_sha256, e.h as folded_root, e.h = r.h as verified
from ended e, (select h from crown where n = 1) r where k = 1
"""

_NEIGHBOURS_SQL = """
with numbered as (select vec_id, cast(embedding as double[]) as e, row_number() over () as own from embeddings),
usable as (
  select * from numbered where len(list_filter(e, lambda x: x <> 0)) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.own, a.vec_id as query_id, b.vec_id, b.own as other, sqrt(list_reduce(
    list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])), lambda x, y: x + y)) as score
  from usable a join usable b on a.own <> b.own and len(a.e) = len(b.e) where a.vec_id % 100 = 0
), ranked as (
  select *, cast(row_number() over (partition by own order by score, vec_id nulls last, other) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

ORACLES = {
    "op11_merkle_manifest": _MERKLE_SQL,
    "op13_block_neighbours": _NEIGHBOURS_SQL,
    "op10_winnowing": _WINNOWING_SQL,
    "op2_minhash_dedup": _DEDUP_SQL,
    "op5_substring_dedup": _SUBSTRING_SQL,
    "op9_chat_events": _CHAT_SQL,
}
