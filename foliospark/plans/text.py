"""Queries on the text layer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.recognition import greedy_decode
from foliospark.plans.common import table
from foliospark.sinks import markup

_LINES = r"""list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def _reflow(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(T.reflow("text")).alias("para", "p"))
    return rows.select("doc_id", F.col("para").cast("long").alias("para"), F.size("p.lines").cast("long").alias("n_lines"), F.col("p.text").alias("paragraph"))


def _reflow_sql(text: str) -> str:
    return rf"""
with p as (
  select doc_id, unnest(list_filter(list_transform(regexp_split_to_array({text}, '[\x00\x0b\x1d\x1f]'), lambda p: {_LINES}), lambda l: len(l) > 0)) as lines,
         generate_subscripts(list_filter(list_transform(regexp_split_to_array({text}, '[\x00\x0b\x1d\x1f]'), lambda p: {_LINES}), lambda l: len(l) > 0), 1) - 1 as para
  from documents)
select doc_id, para, len(lines) as n_lines,
       replace(regexp_replace(array_to_string(lines, chr(10)), '-' || chr(10) || '([a-z])', '\1', 'g'), chr(10), ' ') as paragraph
from p"""


def reflow_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reflow(table(spark, sf_dir, "documents"))


def reflow_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with line breaks and paragraph marks put in, so that every rule is met."""
    docs = table(spark, sf_dir, "documents")
    broken = F.replace(F.replace("text", F.lit("th"), F.lit("t-\nh")), F.lit(". "), F.lit(".\x1d "))
    return _reflow(docs.withColumn("text", broken))


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.escape_html("html").alias("as_html"), T.escape_xml("html").alias("as_xml"), T.escape_pdf("html").alias("as_pdf"), T.inner_text("html").alias("inner_text"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and a blank one and one without text beside each."""
    docs = table(spark, sf_dir, "documents")
    each = F.array(F.struct(F.lit(0).alias("i"), F.col("text").alias("t")), F.struct(F.lit(1).alias("i"), F.lit(" \t ").alias("t")), F.struct(F.lit(2).alias("i"), F.lit(None).cast("string").alias("t")))
    rows = docs.select("doc_id", F.explode(each).alias("e"))
    return rows.select("doc_id", F.col("e.i").cast("long").alias("variant"), T.blank_to(F.col("e.t"), "No text layer").alias("shown"))


def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.length("text").alias("chars"), T.text_width("text").cast("long").alias("milli_em"))


def byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 10 to 50 of every text, whole characters; starts also at 11 to 13, so that some fall within a character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.explode(F.sequence(F.lit(10), F.lit(13))).alias("start"))
    return docs.select("doc_id", F.col("start").cast("long").alias("start"), T.byte_slice("text", F.col("start"), F.lit(40)).alias("slice"))


def _marked_up(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Conversations as pages of 1000 x 1400: a line with one word a turn, as the markup writers put them."""
    word = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(word)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = {"hocr": markup.hocr_page, "alto": markup.alto_page, "json": lambda z, p, i: markup.zones_json(z, p)}[name]
        page = {"width": 1000, "height": 1400, "dpi": 300}
        for batch in batches:
            out = []
            for i, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                zones = [{"zone_id": 0, "parent_id": None, "kind": "page", "x": 0, "y": 0, "w": 1000, "h": 1400, "text": ""}]
                for n, t in enumerate(turns):
                    box = {"x": 5, "y": 10 * n, "w": 990, "h": 9}
                    zones.append({"zone_id": 2 * n + 1, "parent_id": 0, "kind": "line", "text": t["text"], **box})
                    zones.append({"zone_id": 2 * n + 2, "parent_id": 2 * n + 1, "kind": "word", "text": t["text"], **box})
                out.append(write(zones, page, i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["conv_id", name])

    return turns.mapInArrow(run, f"conv_id long, {name} string")


def hocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_up(spark, sf_dir, "hocr")


def alto_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_up(spark, sf_dir, "alto")


def zone_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_up(spark, sf_dir, "json")


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events in order as the best symbols of a recogniser, clicks as blanks, decoded by the greedy decoder."""
    kinds = ["click", "error", "purchase", "scroll", "signup", "view"]
    events = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")).alias("symbol")).alias("e"))
    users = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["symbol"]).alias("symbols"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [greedy_decode(np.eye(len(kinds) + 1)[np.array(s) - 1], "abcdef") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["user_id", "decoded"])

    return users.mapInArrow(run, "user_id long, decoded string")


QUERIES = {f.__name__: f for f in (reflow_paragraphs, reflow_hyphens, escapes, page_text, text_widths, byte_slices, hocr_lines, alto_lines, zone_json, ctc_decode)}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_TURNS = """t as (select conv_id, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) - 1 as n
  from conversations where conv_id is not null)"""
ORACLE_SQL = {
    "reflow_paragraphs": _reflow_sql("text"),
    "reflow_hyphens": _reflow_sql("replace(replace(text, 'th', 't-' || chr(10) || 'h'), '. ', '.' || chr(29) || ' ')"),
    "escapes": r"""
select page_id,
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as as_html,
  replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as as_xml,
  regexp_replace(replace(replace(replace(html, '\', '\\'), '(', '\('), ')', '\)'), '[^\x00-\x7F]', '?', 'g') as as_pdf,
  regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g') as inner_text
from pages""",
    "page_text": rf"""
select doc_id, variant, case when t is null or {_TRIM.format('t')} = '' then 'No text layer' else t end as shown from (
  select doc_id, 0 as variant, text as t from documents union all select doc_id, 1, ' ' || chr(9) || ' ' from documents union all select doc_id, 2, null from documents)""",
    "text_widths": r"""
select conv_id, turn, length(text) as chars, cast(list_sum(list_transform(string_split(text, ''), lambda c: case
  when ascii(c) < 32 or ascii(c) = 127 then 0 when c in (' ', ',', '.', ':', ';', '!', '?') then 278 when c in ('''', '"') then 222
  when c in ('(', ')', '[', ']', '{', '}', '-', '–', '—') then 333 when c between 'A' and 'Z' then 667 else 556 end)) as bigint) as milli_em
from conversations""",
    "byte_slices": """
with c as (select doc_id, string_split(text, '') as cs from documents where text is not null),
e as (select doc_id, unnest(cs) as ch, unnest(range(1, len(cs) + 1)) as i from c),
p as (select *, sum(strlen(ch)) over (partition by doc_id order by i) as last from e),
s as (select unnest(range(10, 14)) as start)
select d.doc_id, s.start, case when d.text is not null then coalesce((select string_agg(ch, '' order by i) from p where p.doc_id = d.doc_id and last > s.start and last - strlen(ch) < s.start + 40), '') end as slice
from documents d, s""",
    "hocr_lines": f"""
with {_TURNS} select conv_id, '  <div class="ocr_page" id="page_' || conv_id || '" title="image page_' || conv_id || '.djvu; bbox 0 0 1000 1400; ppageno ' || conv_id || '">' || chr(10) ||
  string_agg('   <span class="ocr_line" id="line_' || conv_id || '_' || n || '" title="bbox 5 ' || 10 * n || ' 995 ' || (10 * n + 9) || '">' || chr(10) ||
    '     <span class="ocrx_word" id="word_' || conv_id || '_' || n || '" title="bbox 5 ' || 10 * n || ' 995 ' || (10 * n + 9) || '">' || {_ESCAPED} || '</span>' || chr(10) || '   </span>', chr(10) order by n)
  || chr(10) || '  </div>' as hocr from t group by conv_id""",
    "alto_lines": f"""
with {_TURNS} select conv_id, '    <Page ID="page_' || conv_id || '" WIDTH="1000" HEIGHT="1400" PHYSICAL_IMG_NR="' || conv_id || '">' || chr(10) || '      <PrintSpace WIDTH="1000" HEIGHT="1400" HPOS="0" VPOS="0">' || chr(10) ||
  string_agg('        <TextLine ID="line_' || conv_id || '_' || n || '" HPOS="5" VPOS="' || 10 * n || '" WIDTH="990" HEIGHT="9">' || chr(10) ||
    '          <String ID="word_' || conv_id || '_' || n || '" HPOS="5" VPOS="' || 10 * n || '" WIDTH="990" HEIGHT="9" CONTENT="' || replace({_ESCAPED}, '&#39;', '&apos;') || '"/>' || chr(10) || '        </TextLine>', chr(10) order by n)
  || chr(10) || '      </PrintSpace>' || chr(10) || '    </Page>' as alto from t group by conv_id""",
    "zone_json": rf"""
with {_TURNS} select conv_id, '[' || coalesce(string_agg('{{"t":' || cast(to_json(text) as varchar) || ',"x":5,"y":' || 10 * n || ',"w":990,"h":9}}', ',' order by n) filter (where {_TRIM.format('text')} <> ''), '') || ']' as json from t group by conv_id""",
    "ctc_decode": """
with e as (select user_id, ts, event_id, list_position(['click', 'error', 'purchase', 'scroll', 'signup', 'view'], event_type) as s from events),
b as (select *, lag(s) over (partition by user_id order by ts, event_id) as before from e)
select user_id, coalesce(string_agg(chr(95 + cast(s as int)), '' order by ts, event_id) filter (where s > 1 and before is distinct from s), '') as decoded from b group by user_id""",
}
