"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewtrust.llm import (
    byte_bpe,
    collocations,
    fill_middle,
    fingerprints,
    line_dedup,
    mixing,
    packing,
    quality,
    repair,
    rules,
    secrets,
    simhash,
    token_counts,
)
from reviewtrust.llm.common import read, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _content(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    known = labels.where(~_held_out(labels["doc_id"])).select("doc_id", F.col("quality").cast("double").alias("label"))
    return quality.quality_scores(read(spark, sf_dir), known).select(
        "doc_id",
        _held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new for each run, so that the query's work is that of a first run."""
    folder = f"{workspace(spark, 'token-count-cache').root}/counts"
    counts = token_counts.token_counts(read(spark, sf_dir), _content("byte_bpe_50k.json"), folder)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_verdicts(read(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir)).select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        _sha256(F.col("edited")).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def ordered(spans: Column) -> Column:
        rank = F.array(*(F.lit(k) for k in secrets.KINDS))
        keyed = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                # Added kinds come after the base ones.
                F.when(F.array_contains(rank, s["kind"]), F.array_position(rank, s["kind"])).otherwise(99).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
        return F.sort_array(keyed)

    return secrets.secret_spans(read(spark, sf_dir)).select(
        "doc_id",
        *(number(k) for k in secrets.KINDS),
        _sha256(joined(F.col("base"))).alias("base_sha256"),
        joined(ordered(F.concat("base", "added"))).alias("spans"),
    )


@query(
    "op6_line_dedup",
    r"""with doc as (select doc_id, coalesce(text, '') as text from documents),
raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from doc),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from raw),
shared as (select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, s.key is not null and k.doc_id <> s.keeper as dropped from keyed k left join shared s using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir).select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        _sha256(F.coalesce("_kept", F.lit(""))).alias("kept_sha256"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_mix_sources")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_repair_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = workspace(spark, "repair-files")
    blocks = files.write(repair.encode_blocks(read(spark, sf_dir), _content("word_bpe_49k.json"), vocabulary=49408))
    return repair.decode_blocks(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = byte_bpe.sentencepiece_model(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    encoded = byte_bpe.encode(read(spark, sf_dir), model, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op11_fill_middle",
    r"""with doc as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cut as (select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, ('0x' || substr(h, 1, 8))::bigint as h1,
  ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 25, 8))::bigint as h4 from doc),
drawn as (select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from cut),
part as (select *, coalesce(array_to_string(units[1:a], ''), '') as prefix, coalesce(array_to_string(units[a + 1:b], ''), '') as middle,
  coalesce(array_to_string(units[b + 1:], ''), '') as suffix from drawn)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from part""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_middle(read(spark, sf_dir))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        _sha256(F.col("output")).alias("output_sha256"),
        _sha256(restored).alias("restored_sha256"),
    )


@query(
    "op12_collocations",
    r"""with doc as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
piece as (select lang, unnest(string_split_regex(text, '[.,;:!?
-]')) as piece from doc),
line as (select lang, regexp_extract_all(piece, '[^ 	]+') as words from piece),
total as (select lang, sum(len(words))::hugeint as n from line group by lang),
gram as (select lang, unnest(flatten(list_transform(range(1, len(words) + 1), lambda i: list_transform(range(i, least(i + 4, len(words)) + 1), lambda j: words[i:j])))) as words from line),
f as (select lang, words, count(*) as a from gram group by lang, words having count(*) >= 100),
cut as (select f.*, unnest(range(1, len(words))) as k from f where len(words) > 1),
scored as (select c.lang, c.words, c.a, c.k, x.a as l, y.a as r, t.n, (1000 * c.a::hugeint * t.n) // (x.a::hugeint * y.a) as score
  from cut c join f x on x.lang = c.lang and x.words = c.words[1:c.k] join f y on y.lang = c.lang and y.words = c.words[c.k + 1:]
  join total t on t.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, words order by score, k) = 1),
inner_parts as (select lang, a, len(words) as size, unnest(flatten(list_transform(range(1, len(words) + 1), lambda i: list_transform(range(i, len(words) + 1), lambda j: words[i:j])))) as words from f),
around as (select lang, words, max(a) as a from inner_parts where len(words) < size group by lang, words),
kept as (select s.lang, array_to_string(s.words, ' ') as phrase, s.a, s.l, s.r, s.n, s.score from lowest s
  left join around o on o.lang = s.lang and o.words = s.words where o.a is null or 100 * o.a < 100 * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir))


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = packing.pack(read(spark, sf_dir), _content("word_bpe_49k.json"))
    return placed.select("doc_id", "start", F.col("length").cast("bigint"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
