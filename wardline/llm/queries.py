"""Registered queries of the subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import chat, decontaminate, lines, middles, neardup, packing, quality, spellings, substrings, tokens, toxicity, warc
from wardline.session import scratch_path

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    chats = chat.format_chats(chat.turns_of_rows(rows.unionByName(extra))).select("conv_id", "formatted", "loss_spans")
    read = chats.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_line_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.clean_lines(docs, cleaned_col=None).drop("text", "n_failed_lines")


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_repeated_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_repeated_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_fill_in_middle(spark, sf_dir):
    cut = middles.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middles.restored(F.col("output"), F.col("form"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op13_spellings(spark, sf_dir):
    return spellings.spelling_forms(spellings.vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_chat_format, op3_quality, op4_toxicity, op5_token_counts,
        op6_line_rules, op7_best_fit_packing, op8_repeated_words, op9_repeated_bytes, op10_decontaminate,
        op11_warc, op12_fill_in_middle, op13_spellings,
    )
}

_CONTROL = r"</s>[INST] ok [/INST]"
ORACLE = {
    "op8_repeated_words": r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
placed as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, len(w) as n, unnest([case when i <= len(w) - 12 then array_to_string(w[i:i + 12], ' ') end for i in range(1, len(w) + 1)]) as s from words),
first as (select s, min(doc_id) as low from placed where s is not null group by s),
marked as (select placed.*, coalesce(first.low < doc_id, false) as dup from placed left join first using (s)),
gone as (select *, max(dup::int) over (partition by doc_id order by i rows between 12 preceding and current row) as out from marked),
by_doc as (select doc_id, sum(out)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (out = 0), '')) as kept_sha256 from gone group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from words left join by_doc using (doc_id)
""",
    "op9_repeated_bytes": r"""
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
placed as (select doc_id, unnest(range(0, (length(h) // 2)::bigint)) as i, h from bytes),
cut as (select doc_id, i, substr(h, 2 * i + 1, 2) as b, case when 2 * i + 200 <= length(h) then md5_number(substr(h, 2 * i + 1, 200)) end as s from placed),
first as (select s, min(struct_pack(d := doc_id, i := i)) as low from cut where s is not null group by s),
marked as (select doc_id, i, b, coalesce(low < struct_pack(d := doc_id, i := i), false) as dup from cut left join first using (s)),
gone as (select *, max(dup::int) over (partition by doc_id order by i rows between 99 preceding and current row) as out from marked),
runs as (select *, out = 1 and coalesce(lag(out) over (partition by doc_id order by i), 0) = 0 as new from gone),
by_doc as (select doc_id, sum(out)::bigint as n_removed, sum(new::int)::bigint as n_spans, sha256(unhex(coalesce(string_agg(b, '' order by i) filter (out = 0), ''))) as kept_sha256 from runs group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, coalesce(kept_sha256, sha256('')) as kept_sha256
from bytes left join by_doc using (doc_id)
""",
    "op2_chat_format": rf"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}'
), named as (
  select conv_id, turn, role as r0, text as t0, coalesce(text, '') as text,
    coalesce(role, '') as role
  from turns
), marked as (
  select *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?TURN\]|/ROLE\])', '\1\\\2\3', 'g') as safe from named
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(safe) + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 11 else 20 + length(role) end)::bigint as formatted_chars
from marked group by conv_id
""",
    "op10_decontaminate": r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents
  union all select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') from benchmark
), shingles as (
  select distinct kind, id, unnest([array_to_string(w[i:i + 4], chr(1)) for i in range(1, greatest(len(w) - 3, 2))]) as s from words where len(w) > 0
), sizes as (select id as item_id, count(*) as n from shingles where kind = 'i' group by 1),
shared as (
  select d.id as doc_id, i.id as item_id, count(*) as c from shingles d join shingles i on d.s = i.s and d.kind = 'd' and i.kind = 'i' group by 1, 2
), hits as (select doc_id, list(item_id order by item_id) as item_ids from shared join sizes using (item_id) where 100 * c >= 80 * n group by 1)
select d.doc_id, coalesce(len(h.item_ids), 0)::bigint as n_items, coalesce(h.item_ids, []::bigint[]) as item_ids, h.item_ids is null as kept
from documents d left join hits h using (doc_id)
""",
    "op11_warc": """
with read as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
first as (select html, min(page_id) as low from read group by html)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1) for i in range(0, 32)], '') as payload_digest,
  case when page_id = low then 'response' else 'revisit' end as record_type, case when page_id <> low then low end as refers_to
from read join first using (html)
""",
    "op12_fill_in_middle": """
with read as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
sized as (select *, length(t) as n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(0, 4)] as v from read),
cut as (select *, least(v[1] % (n + 1), v[2] % (n + 1)) as a, greatest(v[1] % (n + 1), v[2] % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or v[3] % 100 >= 90 then 'plain' when v[4] % 100 < 20 then 'spm' else 'psm' end as form from sized),
parts as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
""",
    "op13_spellings": """
with recursive polynomial(i, k, c) as (
  select i, 0, i::bigint from range(0, 256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from polynomial where k < 8
), bytes as (select list(c order by i) as crc from polynomial where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents),
lowered as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as m from runs where length(run) >= 7 group by all),
hashed as (select run, m, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * j + 1, 2))::bigint for j in range(0, strlen(doc_id || ':' || run))]),
  lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]))) as h from lowered, bytes),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, m from hashed),
words as (select word, sum(m)::bigint as n from cut where length(word) >= 7 group by word having sum(m) >= 2),
less as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
parts as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from less),
shorter as (select distinct p.word, w.word as near from parts p join words w on w.word = p.a || p.b),
near as (
  select p.word, q.word as near from parts p join parts q using (i, a, b) where p.word <> q.word
  union select word, near from shorter union select near, word from shorter
), best as (select near.word, count(*) as n_near, min(struct_pack(less := -n, near := near)) as top from near join words w on w.word = near.near group by near.word),
forms as (
  select words.word, n, coalesce(n_near, 0)::bigint as n_near, case when -top.less >= 10 * n then top.near end as form, case when -top.less >= 10 * n then -top.less end as form_n
  from words left join best using (word)
), roots as (
  select word, word as root, form as next from forms
  union all select roots.word, roots.next, forms.form from roots join forms on forms.word = roots.next
)
select forms.word, form, root, n, n_near, form_n from forms join (select word, root from roots where next is null) using (word)
""",
}
