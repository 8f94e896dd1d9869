"""One query per operator over its whole table, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import (
    chat,
    chunks,
    decontamination,
    divergence,
    grammar,
    lattice,
    merkle,
    minmax,
    passages,
    simhash,
    toxicity,
    warc,
    whitening,
)
from tieout.llm.common import ascii_lower, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name; ``sql`` gives the same rows in DuckDB."""
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CONTROL_LIKE = "</s>[INST] ok [/INST]"
_SQL_CONTROL = chat.CONTROL.replace("'", "''")


@query(f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONTROL_LIKE}'), (-1, 1, 'assistant', '{CONTROL_LIKE}')),
x as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    length(regexp_replace(text, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g')) as n_text,
    length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g'))
      as n_role
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), ''))
    as loss_sha256,
  cast(sum(n_text + case when before = role then {len(chat.NEXT)}
    else {len(chat.START) + 1 + len(chat.END)} + n_role end) as bigint) as formatted_chars
from x group by conv_id
""")
def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Format every conversation and one made of control strings, and read the output back."""
    planted = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_LIKE), (-1, 1, "assistant", CONTROL_LIKE)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.format_chats(turns).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("learned"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("""
with x as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from x),
k as (select digest, max(page_id) as kept from d where n >= 1000 group by digest)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when kept is null or page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id <> kept then kept end as refers_to
from d left join k using (digest)
""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive every page, normalise the archives and list the records read back by offset."""
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every whole text from content-defined chunks and decode the ids."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    coded = chunks.encode(documents, "byte_bpe_50k.json").select("doc_id", "ids")
    return chunks.decode(coded, "byte_bpe_50k.json").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(chunks.joined_ids("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op6_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Write every document's ids as grammar-compressed shards in doc_id order and read them back."""
    shards = grammar.write_ids(table(spark, folder, "documents"), "word_bpe_49k.json",
                               scratch_folder(spark, "token-ids"), end_id=1, base=49408)
    return grammar.read_ids(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def remainder(divisor: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows that are not held out."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    weights = toxicity.fit(documents, labels, teaches=remainder(5) != 0)
    return toxicity.score(documents.select("doc_id", "text"), weights).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_KINDS = ["[^A-Z]", "[^0-9]", "[^#*$%&|<>]", r"[^.,;:!?''\x22()-]", r"[\x00-\x7F]"]
_COUNTS = ", ".join(f"length(regexp_replace(text, '{kind}+', '', 'g'))" for kind in _KINDS)


def _js(left: str, right: str) -> str:
    """SQL for the squared Jensen-Shannon distance of two lists of counts, null if one has none."""
    p, q = f"({left}[k] / nullif(list_sum({left}), 0))", f"({right}[k] / nullif(list_sum({right}), 0))"
    side = "case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
    terms = f"{side.format(a=p, b=q)} + {side.format(a=q, b=p)}"
    return (f"case when list_sum({left}) > 0 and list_sum({right}) > 0 then "
            f"list_sum([{terms} for k in range(1, len({left}) + 1)]) / 2 end")


@query(rf"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, row_number() over () as r,
    (('0x' || md5(coalesce(source, ''))[:6])::bigint % {divergence.SOURCE_GROUPS}) * {divergence.TEXT_GROUPS}
      + ('0x' || md5(coalesce(text, ''))[:6])::bigint % {divergence.TEXT_GROUPS} as cell from documents),
w as (
  select r, doc_id, lang, cell, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    [{_COUNTS}] as kinds
  from d),
m as (
  select r, doc_id, lang, cell, length(text) as n_chars, words, len(words) as n_words,
    length(array_to_string(words, '')) as word_chars, kinds[3] as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    list_concat(kinds, [length(text) - length(array_to_string(words, '')),
      length(array_to_string(words, '')) - cast(list_sum(kinds) as bigint)]) as classes
  from w),
windows as (
  select r, i, list_slice(words, i, i + 7) as shingle from (
    select r, words, unnest(range(1, n_words - 6)) as i from m where n_words >= 8)),
again as (select r, i, count(*) over (partition by r, shingle) as n from windows),
repeated as (
  select r, count(distinct p) as n_repeat_words from (
    select r, unnest(range(i, i + 8)) as p from again where n > 1) group by r),
cells as (
  select lang, {", ".join(f"cast(sum(classes[{k}]) as double) / nullif(sum(n_chars), 0) as s{k}" for k in range(1, 8))},
    cast(sum(n_words) as double) as n_words from m group by lang, cell),
usual as (
  select lang, [{", ".join(f"median(s{k})" for k in range(1, 8))}] as classes, sum(n_words) as n_words
  from cells group by lang),
tokens as (select r, lang, unnest(words) as word from m),
ranked as (
  select lang, word, count(*) as n, row_number() over (partition by lang order by count(*) desc, word) as place
  from tokens group by lang, word qualify place <= 16),
frequent as (
  select lang, list(cast(n as double) order by place) as n, list(word order by place) as words from ranked group by lang),
used as (
  select r, list(n order by place) as n from (
    select m.r, k.place, cast(len(list_filter(m.words, lambda x: x = k.word)) as double) as n
    from m join ranked k on m.lang = k.lang) group by r),
distances as (
  select m.*, coalesce(n_repeat_words, 0) as n_repeat_words,
    list_transform(m.classes, lambda x: cast(x as double)) as own, u.classes as usual,
    list_concat(used.n, [m.n_words - list_sum(used.n)]) as own_common,
    list_concat(f.n, [u.n_words - list_sum(f.n)]) as usual_common
  from m left join repeated using (r) join usual u using (lang) left join used using (r) left join frequent f using (lang)),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    {_js("own", "usual")} as by_class, {_js("own_common", "usual_common")} as by_common
  from distances)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and not coalesce(n_words >= 30 and by_class > 0.09, false)
    and not coalesce(n_words >= 100 and by_common > 0.25, false) as kept
from judged
""")
def op10_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict for every whole text, against the usual text of its language."""
    return divergence.judge(table(spark, folder, "documents")).drop("class_distance", "common_distance")


@query(r"""
with d as (
  select doc_id, row_number() over () as r, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') as words from documents),
b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
    lambda x: x <> '') as words from benchmark),
w as (
  select distinct item_id, list_slice(words, i, i + 12) as shingle from (
    select item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from b where len(words) > 0)),
lengths as (select distinct len(shingle) as n from w),
places as (
  select r, i, n, list_slice(words, i, i + n - 1) as shingle from (
    select r, words, n, unnest(range(1, len(words) - n + 2)) as i from d, lengths where len(words) >= n)),
found as (select distinct r, i, n, item_id from places join w using (shingle)),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (
    select distinct r, cast(item_id as varchar) as item from found where item_id is not null) group by r)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join hits using (r) left join items using (r)
""")
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every whole document that stand in a window of a benchmark item."""
    return decontamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("mark")


@query()
def op8_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every whole text over all segmentations, beside an add-one base."""
    documents = table(spark, folder, "documents")
    return lattice.score(documents, remainder(7) != 2).withColumn("held_out", remainder(7) == 2)


@query()
def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that a whole document shares with an earlier one, exact or with few edits."""
    return passages.shared_passages(table(spark, folder, "documents")).drop("mark", "other_mark")


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ASCII text, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    half = f"(xor(c >> 4, [{', '.join(map(str, table))}][1 + ((xor(c, x)) & 15)]))"
    nibbles = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii({text}[i]) & 15, ascii({text}[i]) >> 4]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {nibbles}::bigint[]), lambda c, x: {half}), 4294967295)"


def _merkle_sql() -> str:
    """Trees of up to 8^8 leaves, a level at a time: nodes, then the siblings of each leaf's ancestors, then what the
    leaf and they fold to."""
    levels = range(8)
    field = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"
    leaf = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, source: str) -> str:
        """Levels of the trees of ``source (k, p, h, w)``, with the leaves' siblings and folded digests."""
        parts = [f"{name}0 as (select k, p, h, w from {source})"]
        for n in levels:
            parts.append(f"""{name}{n + 1} as (
  select k, p // 8 as p, sha256(string_agg(h, '' order by p)) as h, (any_value(w) + 7) // 8 as w from {name}{n} where w > 1
  group by k, p // 8 union all select k, p, h, w from {name}{n} where w = 1)""")
        return ",\n".join(parts)

    def climb(name: str, start: str) -> str:
        """From ``start (id, k, p, w, f, s)``: ``f`` folded up and ``s`` with all siblings appended."""
        parts = [f"{name}_0 as (select id, k, p, w, f, s from {start})"]
        for n in levels:
            parts.append(f"""{name}_{n + 1} as (
  select c.id, any_value(c.k) as k, any_value(c.p) // 8 as p, (any_value(c.w) + 7) // 8 as w,
    sha256(string_agg(case when t.p = c.p then c.f else t.h end, '' order by t.p)) as f,
    any_value(c.s) || coalesce(string_agg(t.h, '' order by t.p) filter (where t.p <> c.p), '') as s
  from {name}_{n} c join {name[0]}{n} t on t.k = c.k and t.p // 8 = c.p // 8 where c.w > 1 group by c.id
  union all select id, k, p, w, f, s from {name}_{n} where w = 1)""")
        return ",\n".join(parts)

    return f"""
with d as (
  select doc_id, lang, sha256({leaf} || {field.format("text")}) as h,
    case when ({_crc32("coalesce(doc_id::varchar, '')")}) % 3 = 0 and doc_id is not null
      then sha256({leaf} || {field.format(lower)}) else sha256({leaf} || {field.format("text")}) end as f
  from documents),
g as (select lang, row_number() over (order by lang nulls first) - 1 as k from (select distinct lang from d)),
l as (
  select row_number() over () as id, doc_id, d.h, f, k, row_number() over (partition by k order by doc_id nulls first, d.h) - 1 as p,
    count(*) over (partition by k) as w
  from d join g on d.lang is not distinct from g.lang),
{tree("a", "l")},
r as (select k as p, h, count(*) over () as w, 0 as k from a8),
{tree("b", "r")},
s as (select id, k, p, w, f, '' as s from l),
{climb("a", "s")},
u as (select a.id, 0 as k, a.k as p, r.w, a.f, a.s from a_8 a join r on r.p = a.k),
{climb("b", "u")}
select doc_id, l.h as leaf, a8.h as subroot, b8.h as root, sha256(x.s) as proof_sha256, x.f as folded_root, x.f = b8.h as verified
from l join b_8 x using (id) join a8 on a8.k = l.k cross join b8
"""


@query(_merkle_sql())
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of every document, and what each proof says of texts of which a third have been tampered with."""
    lowered = F.when(remainder(3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.certify(table(spark, folder, "documents"), lowered).withColumn(
        "proof_sha256", F.sha2(F.lower(F.hex("proof")), 256)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector on the first eight components of the exact covariance."""
    return whitening.whiten(table(spark, folder, "embeddings"))


_BLANK = r"[\x20\x09-\x0D]+"


@query(rf"""
with recursive d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') as words from documents),
s as (
  select distinct r, array_to_string(list_slice(words, i, i + 4), ' ') as shingle from (
    select r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from d where len(words) > 0)),
n as (select r, count(*) as n from s group by r),
x as (select a.r as a, b.r as b, count(*) as n from s a join s b on a.shingle = b.shingle and a.r <> b.r group by a.r, b.r),
links as (select x.a, x.b from x join n p on p.r = x.a join n q on q.r = x.b where 100 * x.n >= 85 * (p.n + q.n - x.n)),
reach as (select r as a, r as b from d union select reach.a, links.b from reach join links on links.a = reach.b),
c as (select a, min(doc_id) as component_id from reach join d on d.r = reach.b group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept
from d join c on c.a = d.r left join n using (r)
""")
def op13_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minmax.near_duplicates(table(spark, folder, "documents"))


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus without toxic, near-duplicate and contaminated documents and repeated passages, encoded."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
