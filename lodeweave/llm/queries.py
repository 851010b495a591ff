"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(parts, 1) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select doc_id, pos, line, translate(
    regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), firsts as (
  select key, min(doc_id) as first_id from keyed where length(key) >= 10 group by key
), marked as (
  select k.doc_id, k.pos, k.line, coalesce(f.first_id <> k.doc_id, false) as gone
  from keyed k left join firsts f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs (place: the line) and passages that an earlier document has (place: the first word).

    Per row: where it is, where the one that stays is, whether it goes; of a passage keep_place and cluster_size are null.
    """
    from .substring_dedup import repeated_texts

    lines, spans = repeated_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = lines.select(F.lit("paragraph").alias("kind"), "*")
    spans = spans.select(
        F.lit("passage").alias("kind"), "doc", F.col("start").alias("place"), (F.col("stop") - F.col("start")).cast("long").alias("words"),
        "keep_doc", F.lit(None).cast("int").alias("keep_place"), F.lit(None).cast("long").alias("cluster_size"), F.lit(True).alias("removed"),
    )
    return lines.unionByName(spans).withColumnsRenamed({"doc": "doc_id", "keep_doc": "keep_doc_id"})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = read_back(format_chats(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# Lengths of the template's marks: begin 9, end 7, role 8, text 8, next 8; each backslash, < and [ gets a backslash.
OP3_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as merged,
    length(regexp_replace(text, '([\\<\[])', '_\1', 'g')) as escaped_chars,
    length(regexp_replace(role, '([\\<\[])', '_\1', 'g')) as role_chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(9 + sum(escaped_chars + case when merged then 8 else 7 + 16 + role_chars end) as bigint) as formatted_chars
from marked group by conv_id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(
        F.col("doc").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = r"""
with texts as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = min(doc_id) over g as kept, text_sha256
from texts window g as (partition by text_sha256)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_groups

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs, k=3, num=90, den=100).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


OP7_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select distinct doc_id, array_to_string(w[s:s + 2], ' ') as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as s from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as a, doc_id as b from words union select r.a, l.b from reached r join both_ways l on r.b = l.a
)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reached group by a) left join sizes using (doc_id)
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, find_items

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP8_SQL = f"""
with docs as (
  select doc_id, {_WORDS_SQL} as words from documents
), items as (
  select cast(item_id as varchar) as item, {_WORDS_SQL} as words from benchmark
), sized as (
  select item, words, least(13, len(words)) as m from items where len(words) > 0
), windows as (
  select distinct item, m, array_to_string(words[s:s + m - 1], ' ') as gram
  from (select item, words, m, unnest(range(1, len(words) - m + 2)) as s from sized)
), places as (
  select doc_id, m, s, array_to_string(words[s:s + m - 1], ' ') as gram
  from (select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as s
        from docs, (select distinct m from sized) where len(words) >= m)
), found as (
  select doc_id, p.m, s, item from places p join windows w on p.m = w.m and p.gram = w.gram
), hits as (
  select doc_id, count(distinct w) as n_hit
  from (select doc_id, unnest(range(s, s + m)) as w from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, item from found) group by doc_id
)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(list, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs d left join hits using (doc_id) left join named using (doc_id)
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import in_training, score_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs).withColumnRenamed("doc", "doc_id")
    return scored.select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of the distinct words only, byte by byte from their hex digits.
OP11_SQL = f"""
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as step
), words as (
  select 'd' as side, doc_id, {_WORDS_SQL} as words from documents
  union all select 't', null, {_WORDS_SQL} from benchmark
), flat as (
  select side, doc_id, rid, unnest(words) as word from (select *, row_number() over () as rid from words)
), bytes as (
  select word, list_transform(range(1, length(code), 2), lambda i: cast(
    16 * (instr('0123456789ABCDEF', code[i]) - 1) + instr('0123456789ABCDEF', code[i + 1]) - 1 as bigint)) as b
  from (select word, hex(encode(word)) as code from (select distinct word from flat))
), hashed as (
  select word, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[xor(c, x) % 256 + 1]), cast(4294967295 as bigint)), 4294967295) % 10000 as bucket
  from bytes, crc_table
), counts as (
  select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 't') as t from flat join hashed using (word) group by bucket
), totals as (
  select sum(s) as s_all, sum(t) as t_all from counts
), gains as (
  select bucket, floor(1000 * ln(cast(t + 1 as double) * (s_all + 10000) / (cast(s + 1 as double) * (t_all + 10000)))) as gain from counts, totals
), weighed as (
  select rid, doc_id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight
  from flat join hashed using (word) join gains using (bucket) where side = 'd' group by all
), docs as (
  select w.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    cast('0x' || substr(sha256('2024:' || cast(w.doc_id as varchar)), 1, 8) as bigint) as h
  from (select *, row_number() over () as rid from words) w left join weighed using (rid) where side = 'd'
), scored as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from docs
), placed as (
  select *, n_features >= 20 and score is not null as able,
    row_number() over (partition by n_features >= 20 and score is not null order by score desc, doc_id) as place
  from scored
)
select doc_id, n_features, weight, score,
  case when able and place <= 10 * (select count(*) from placed where able) // 100 then place end as rank
from placed
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP12_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    case when doc_id is null then 9223372036854775807 else cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 15) as bigint) end as shuffle,
    row_number() over () as rid
  from documents
), sources as (
  select source, sum(size) as source_size, row_number() over (order by source nulls last) as place from sized group by source
), weighed as (
  select *, [5, 2, 1][(place - 1) % 3 + 1] as weight from sources
), filled as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as rate,
    row_number() over (order by source_size / weight, place) as turn
  from weighed window before as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)
), rates as (
  select coalesce(min_by(rate, turn) filter (where weight * rate < 3 * source_size), 0) as rate from filled
), targets as (
  select source, place, source_size, least(weight * cast(r.rate as double), cast(3 * source_size as double)) as target from weighed, rates r
), queue as (
  select rid, doc_id, size, place, source_size, target,
    sum(size) over (partition by place order by shuffle, doc_id nulls last, size rows unbounded preceding) as upto
  from sized join targets on sized.source is not distinct from targets.source
), turns as (
  select rid, size, place, epoch * source_size + upto as reached, (epoch * source_size + upto) / target as finish
  from queue, range(3) e(epoch) where size > 0
), line as (
  select rid, size, sum(size) over (order by finish, place, reached rows unbounded preceding) as used from turns
), taken as (
  select rid, sum(size) as taken from line where used <= (select sum(size) from sized) group by rid
)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken
from queue left join taken using (rid)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search_documents(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = f"""
with docs as (
  select doc_id, row_number() over () as rid, {_WORDS_SQL} as words from documents
), totals as (
  select count(*) as n_docs, sum(len(words)) as n_terms from docs where len(words) > 0
), asked as (
  select distinct item, item_id, term
  from (select row_number() over () as item, item_id, unnest({_WORDS_SQL}) as term from benchmark)
), postings as (
  select rid, doc_id, n, term, count(*) as tf
  from (select rid, doc_id, len(words) as n, unnest(words) as term from docs) semi join asked using (term) group by all
), weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from postings, totals group by term, n_docs
), scores as (
  select item, item_id, rid, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) as score
  from asked join postings using (term) join weights using (term), totals group by item, item_id, rid, doc_id
)
select item_id, cast(row_number() over best as int) as rank, doc_id, score
from scores where score > 0
window best as (partition by item order by score desc, doc_id nulls last)
qualify row_number() over best <= 10
"""


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_ngram_join": op7_ngram_join,
        "op8_decontaminate": op8_decontaminate,
        "op9_lm_score": op9_lm_score,
        "op10_html_extract": op10_html_extract,
        "op11_importance": op11_importance,
        "op12_mixing": op12_mixing,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op3_chat_format": OP3_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op7_ngram_join": OP7_SQL,
        "op8_decontaminate": OP8_SQL,
        "op11_importance": OP11_SQL,
        "op12_mixing": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
