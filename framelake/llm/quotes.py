"""Chat formatting: link quotations to the messages they quote and order conversations by reply."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, materialise, read_table
from .urls import possible

#: A line with quote marks, and a text with such a line.
_MARKS = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?")
QUOTED = r"(?md)^[ \t]{0,3}>"
#: Passages are compared by runs of so many words, whatever their lines; shorter passages link with nothing.
RUN_WORDS = 3
#: A passage is a quotation of a message that has this share of its runs.
LINK_SHARE = 0.8
#: Turns of a block, in which the next reply to a message is looked for first.
BLOCK = 1024
#: So many copies of each quoted run meet the rows that quote it.
SALT = 8
MADE = ("parent_turn", "root_turn", "depth", "thread_position", "n_quoted", "n_linked")


def passages(text: str) -> list[tuple[int, list[int]]]:
    """(level, line numbers) of neighbouring lines with the same number of quote marks."""
    lines = text.split("\n")
    levels = [m[1].count(">") if (m := _MARKS.match(x)) else 0 for x in lines]
    return [(level, list(some)) for level, some in groupby(range(len(lines)), key=levels.__getitem__)]


def plain_words(lines: list[str]) -> list[str]:
    """Words of lines without their quote marks, case, accents' form, punctuation and line breaks."""
    said = " ".join(_MARKS.sub("", x) for x in lines)
    return re.findall(r"\w+", unicodedata.normalize("NFKC", said).casefold())


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)


def run_hashes(words: list[str]) -> list[int]:
    """Hashes of the distinct runs of ``RUN_WORDS`` words."""
    runs = {" ".join(words[i : i + RUN_WORDS]) for i in range(len(words) - RUN_WORDS + 1)}
    return [_digest(x.encode()) for x in sorted(runs)]


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of each quoted passage; a passage without runs is one row with none."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("at", "passage", "level", "runs", "content", "hash")}
        for i, text in enumerate(b.column("text").to_pylist()):
            lines = text.split("\n")
            for k, (level, some) in enumerate(passages(text)):
                if level:
                    found = run_hashes(plain_words([lines[n] for n in some]))
                    content = _digest(b"".join(h.to_bytes(8, "big", signed=True) for h in sorted(found)))
                    for h in found or [None]:
                        for name, v in zip(out, (i, k, level, len(found), content, h), strict=True):
                            out[name].append(v)
        at = pa.array(out.pop("at"), pa.int64())
        kinds = {"passage": pa.int32(), "level": pa.int32(), "runs": pa.int64(), "content": pa.int64(), "hash": pa.int64()}
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("_key", "conv_id", "turn")), *(pa.array(v, kinds[k]) for k, v in out.items())], names=["_key", "conv_id", "turn", *out])


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of each message's own lines."""
    for b in batches:
        at, hashes = [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            lines = text.split("\n")
            found = run_hashes(plain_words([lines[n] for level, some in passages(text) if not level for n in some]))
            at += [i] * len(found)
            hashes += found
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("conv_id", "turn")), pa.array(hashes, pa.int64())], names=["conv_id", "turn", "hash"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their linked passages."""
    for b in batches:
        own = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            lines = text.split("\n")
            kept = [lines[n] for k, (_, some) in enumerate(passages(text)) if k not in (gone or ()) for n in some]
            own.append("\n".join(kept).strip("\n") if gone else text)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()) if c == "text" else b.column(c) for c in b.schema.names], names=b.schema.names)


def _next(rows: DataFrame, group: list[str], turn: str, out: str) -> DataFrame:
    """``out``: the next greater ``turn`` of the group, in blocks of turns, so that no group is in one task."""
    d = rows.withColumn("_b", F.floor(F.col(turn) / BLOCK))
    firsts = d.groupBy(*group, "_b").agg(F.min(turn).alias("_f"))
    firsts = firsts.select(*group, "_b", F.lead("_f").over(Window.partitionBy(*group).orderBy("_b")).alias("_then"))
    inside = F.lead(turn).over(Window.partitionBy(*group, "_b").orderBy(turn))
    return d.withColumn(out, inside).join(firsts, [*group, "_b"]).withColumn(out, F.coalesce(out, "_then")).drop("_b", "_then")


def _jumped(rows: DataFrame, key: list[str], to: list[str], add: str) -> DataFrame:
    """Pointer doubling: ``add`` summed over each row and all that its pointers ``to`` lead to, and ``end``, the first of ``key`` of the last of them.

    ``to`` is null at the end of a chain, and ``end`` null in a row that is its own end. Each round doubles
    the length of the pointers and is a written table.
    """
    rows = materialise(rows.withColumn("end", F.col(to[0])), "chat-jump")
    while not rows.where(F.col(to[0]).isNotNull()).isEmpty():
        there = rows.select("conv_id", *[F.col(k).alias(t) for k, t in zip(key, to, strict=True)], F.col(add).alias("_more"), F.col("end").alias("_end"), *[F.col(t).alias(f"_{t}") for t in to])
        joined = rows.join(there, ["conv_id", *to], "left")
        further = joined.select("conv_id", *key, (F.col(add) + F.coalesce("_more", F.lit(0))).alias(add), F.coalesce("_end", to[0], "end").alias("end"), *[F.col(f"_{t}").alias(t) for t in to])
        before, rows = rows, materialise(further, "chat-jump")
        discard(before)
    return rows


def threads(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, thread_position) of every message of (conv_id, turn, parent_turn) and of their parents.

    ``thread_position`` is the message's place in the depth-first order of its thread, replies to
    one message by turn. It is the message's rank in the tour that enters and leaves every message
    of the thread; root, depth and rank come from pointer doubling, a written table a round.
    """
    e = materialise(edges.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn")), "chat-edges")
    nodes = e.select("conv_id", "turn").union(e.select("conv_id", "parent_turn")).distinct()
    sibling = _next(e, ["conv_id", "parent_turn"], "turn", "sibling").select("conv_id", "turn", "parent_turn", "sibling")
    child = e.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    n = materialise(nodes.join(sibling, ["conv_id", "turn"], "left").join(child, ["conv_id", "turn"], "left"), "chat-nodes")
    up = n.select("conv_id", "turn", F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("parent_turn").alias("to"))
    up = _jumped(up, ["turn"], ["to"], "steps").select("conv_id", "turn", F.coalesce("end", "turn").alias("root_turn"), F.col("steps").alias("depth"))
    number = lambda c: c.cast("long")
    enter = n.select("conv_id", "turn", number(F.lit(0)).alias("side"), number(F.lit(1)).alias("rank"), F.coalesce("child", "turn").alias("to"), number(F.col("child").isNull()).alias("to_side"))
    leave = n.select("conv_id", "turn", number(F.lit(1)).alias("side"), number(F.lit(0)).alias("rank"), F.coalesce("sibling", "parent_turn").alias("to"), F.when(F.col("parent_turn").isNotNull(), number(F.col("sibling").isNull())).alias("to_side"))
    left = _jumped(enter.union(leave), ["turn", "side"], ["to", "to_side"], "rank").where("side = 0").select("conv_id", "turn", "rank")
    whole = left.select("conv_id", F.col("turn").alias("root_turn"), F.col("rank").alias("_all"))
    placed = up.join(left, ["conv_id", "turn"]).join(whole, ["conv_id", "root_turn"])
    return placed.select("conv_id", "turn", "root_turn", "depth", (F.col("_all") - F.col("rank")).alias("thread_position"))


def sayers(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """(conv_id, content, n, said): for each passage and number of its runs that some message has, if enough, the first such message.

    ``wanted`` are (conv_id, content, runs, hash) of distinct passages, ``said`` (conv_id, turn, hash) of messages. A message with
    ``LINK_SHARE`` of a passage's runs has one of its rarest runs, of as many as may be missing and one more: only these
    propose messages, and all runs are counted for those proposed. So a run that every message has proposes none,
    unless a passage is made of such runs, and no link is lost.
    """
    often = said.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("_often"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "content").orderBy(F.coalesce("_often", F.lit(0)), "hash"))
    need = F.ceil(F.lit(LINK_SHARE) * F.col("runs") - 1e-9)
    rare = wanted.join(often, ["conv_id", "hash"], "left").withColumn("_n", nth).where((F.col("_n") <= F.col("runs") - need + 1) & F.col("_often").isNotNull())
    rare = rare.select("conv_id", "content", "runs", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = said.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALT)).cast("int"))
    proposed = materialise(rare.join(salted, ["conv_id", "hash", "salt"]).select("conv_id", "content", F.col("turn").alias("said")).distinct(), "chat-proposed")
    counted = proposed.join(wanted, ["conv_id", "content"]).join(said.withColumnRenamed("turn", "said"), ["conv_id", "said", "hash"])
    counted = counted.groupBy("conv_id", "content", "runs", "said").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(LINK_SHARE) * F.col("runs"))
    return counted.groupBy("conv_id", "content", "n").agg(F.min("said").alias("said"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with their place in reply order and without quotes.

    Neighbouring lines of one quote level are a passage. A passage of at least ``RUN_WORDS`` words
    is linked to an earlier message of its conversation that itself, outside its own quotes,
    has ``LINK_SHARE`` of the passage's runs of words, however either is broken into lines; of several, to
    the one that has most of them, then the first, the original. Linked passages of any level are removed from the
    text; others, such as program prompts, stay as they are.

    ``parent_turn`` is the message that the outermost linked passages come from, of several the one with most runs, then
    the latest; ``root_turn``, ``depth`` and ``thread_position`` place the message in its thread. A conversation
    in reply order is its rows by (root_turn, thread_position, turn), see ``in_order``. ``n_quoted`` and
    ``n_linked`` count passages.

    Only texts with quote marks are shuffled; of the others only runs that are quoted. Equal passages of a
    conversation are looked up once, see ``sayers``, and a passage that many messages quote meets them
    salted. Null text stays null; rows with a null conversation or turn link with nothing;
    rows repeated under one turn are at one place; very long texts are no special case; an empty table gives an
    empty result. Other columns of ``messages`` stay unless results have their names.
    """
    keep = [c for c in messages.columns if c not in MADE]
    rows = messages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    has = F.coalesce(F.col("text").rlike(QUOTED), F.lit(False))
    marked = materialise(rows.where(has).withColumn("_key", F.monotonically_increasing_id()), "chat-marked")
    quoted = marked.select("_key", "conv_id", "turn", "text").mapInArrow(_quoted, "_key long, conv_id string, turn long, passage int, level int, runs long, content long, hash long")
    quoted = materialise(quoted, "chat-quoted")
    wanted = materialise(quoted.where("hash is not null and conv_id is not null and turn is not null").select("conv_id", "content", "runs", "hash").distinct(), "chat-wanted")
    asked = materialise(wanted.select("conv_id", "hash").distinct(), "chat-asked")
    others = possible(rows.where("text is not null and turn is not null").select("conv_id", "turn", "text"), asked.select(F.col("conv_id").alias("url")).distinct(), "conv_id")
    said = others.where("possible").drop("possible").mapInArrow(_said, "conv_id string, turn long, hash long").join(asked, ["conv_id", "hash"])
    said = materialise(said.distinct(), "chat-said")
    first = sayers(wanted, said).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    each = quoted.where("hash is not null").select("_key", "conv_id", "turn", "passage", "level", "content", F.pmod(F.xxhash64("_key"), F.lit(SALT)).cast("int").alias("salt")).distinct()
    met = each.join(first, ["conv_id", "content", "salt"]).where("said < turn")
    best = F.max(F.struct("n", (-F.col("said")).alias("first")))
    linked = met.groupBy("_key", "passage", "level").agg(best.alias("b")).select("_key", "passage", "level", (-F.col("b.first")).alias("said"), "b.n")
    linked = materialise(linked, "chat-linked")
    found = linked.groupBy("_key", "level", "said").agg(F.sum("n").alias("n")).groupBy("_key").agg(F.max(F.struct(-F.col("level"), "n", "said"))["said"].alias("parent_turn"))
    gone = linked.groupBy("_key").agg(F.collect_set("passage").alias("gone"))
    counts = quoted.groupBy("_key").agg(F.count_distinct("passage").alias("n_quoted"))
    per = materialise(marked.select("_key", "conv_id", "turn").join(counts, "_key", "left").join(found, "_key", "left").join(gone, "_key", "left"), "chat-parents")
    place = materialise(threads(per.where("parent_turn is not null").select("conv_id", "turn", "parent_turn")), "chat-threads")
    per = per.join(place, ["conv_id", "turn"], "left")
    schema = T.StructType([f for f in marked.select("_key", "text").schema.fields] + [T.StructField("gone", T.ArrayType(T.IntegerType()))])
    stripped = marked.join(per.drop("conv_id", "turn"), "_key")
    texts = stripped.select("_key", "text", "gone").where("gone is not null").mapInArrow(_without, schema).select("_key", F.col("text").alias("own"))
    stripped = stripped.join(texts, "_key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = F.coalesce("own", "text")
    cols = lambda text: [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep]
    with_marks = stripped.select(*cols(own), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), number(F.col("depth")).alias("depth"), number(F.col("thread_position")).alias("thread_position"), number(F.col("n_quoted")).alias("n_quoted"), number(F.size("gone")).alias("n_linked"))
    zero = F.lit(0).cast("long")
    plain = rows.where(~has).select(*cols(F.col("text")), F.lit(None).cast("long").alias("parent_turn"), F.col("turn").alias("root_turn"), zero.alias("depth"), zero.alias("thread_position"), zero.alias("n_quoted"), zero.alias("n_linked"))
    return with_marks.unionByName(plain)


def in_order(linked: DataFrame) -> DataFrame:
    """The rows of ``link_quotes`` in the order of their conversations' replies, from the first partition to the last."""
    order: list[str | Column] = ["conv_id", "root_turn", "thread_position", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, quotes linked and removed, with each message's place in reply order."""
    return link_quotes(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def planted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with quotes planted: two of three messages quote the one before, one of three also that before it, a level deeper."""
    m = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = m.groupBy("conv_id", "turn").agg(F.max("text").alias("_said"))
    before = lambda n: one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("_said").alias(f"_said{n}"))
    x = m.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    marked = lambda n, mark: F.when(F.pmod("turn", F.lit(3)) >= n, F.concat(F.lit(mark), F.regexp_replace(f"_said{n}", "\n", f"\n{mark}"), F.lit("\n")))
    quoted = F.concat(F.coalesce(marked(2, "> > "), F.lit("")), F.coalesce(marked(1, "> "), F.lit("")), "text")
    return link_quotes(materialise(x.select("conv_id", "turn", "role", quoted.alias("text")), "chat-planted"))


QUERIES = {"op7_quotes": op7_quotes, "planted_quotes": planted_quotes}
_INPUT = "with recursive m as (select row_number() over () k, conv_id, turn, role, text from conversations),"
_PLANTED = """with recursive one as (select conv_id, turn, max(text) said from conversations group by conv_id, turn),
m as (select row_number() over () k, c.conv_id, c.turn, role, coalesce(case when c.turn % 3 >= 2 then '> > ' || replace(b.said, chr(10), chr(10) || '> > ') || chr(10) end, '')
  || coalesce(case when c.turn % 3 >= 1 then '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) end, '') || text as text
  from conversations c left join one a on a.conv_id = c.conv_id and a.turn = c.turn - 1 left join one b on b.conv_id = c.conv_id and b.turn = c.turn - 2),"""
_LINKED = r"""
l as (select k, conv_id, turn, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) n from m),
v as (select *, len(regexp_replace(regexp_extract(line, '^((?:[ \t]{0,3}>)+)', 1), '[^>]', '', 'g')) lv, regexp_replace(line, '^(?:[ \t]{0,3}>)+[ \t]?', '') c from l),
w as (select *, lv is distinct from lag(lv) over (partition by k order by n) nw from v),
p as (select *, sum(nw::int) over (partition by k order by n) pa from w),
s as (select k, conv_id, turn, lv, case when lv > 0 then pa end pa, regexp_extract_all(lower(string_agg(c, ' ' order by n)), '[\p{L}\p{N}_]+') ws from p group by k, conv_id, turn, lv, case when lv > 0 then pa end),
r as (select k, conv_id, turn, lv, pa, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) rs from s),
q as (select k, conv_id, turn, lv, pa, len(rs) nr, unnest(rs) run from r where lv > 0),
o as (select distinct conv_id, turn, unnest(rs) run from r where lv = 0 and turn is not null),
t as (select q.k, q.conv_id, q.turn, q.pa, q.lv, o.turn said, count(*) n from q join o using (conv_id, run) where o.turn < q.turn group by q.k, q.conv_id, q.turn, q.pa, q.lv, o.turn, nr having count(*) >= 0.8 * nr),
g as (select k, conv_id, turn, pa, lv, arg_max(said, (n, -said)) said, max(n) n from t group by k, conv_id, turn, pa, lv),
a as (select k, conv_id, turn, lv, said, sum(n) n from g group by all),
e as (select k, conv_id, turn, arg_max(said, (-lv, n, said)) parent_turn from a group by k, conv_id, turn),
ed as (select conv_id, turn, max(parent_turn) parent_turn from e group by conv_id, turn),
tr(conv_id, turn, root_turn, path) as (select distinct conv_id, parent_turn, parent_turn, [parent_turn] from ed x where not exists (select 1 from ed y where y.conv_id = x.conv_id and y.turn = x.parent_turn)
  union all select ed.conv_id, ed.turn, tr.root_turn, list_append(tr.path, ed.turn) from ed join tr on tr.conv_id = ed.conv_id and tr.turn = ed.parent_turn),
po as (select *, row_number() over (partition by conv_id, root_turn order by path) - 1 place from tr),
nq as (select k, count(*) n from s where lv > 0 group by k), nl as (select k, count(*) n from g group by k),
tx as (select p.k, trim(string_agg(p.line, chr(10) order by p.n) filter (g.k is null), chr(10)) own from p left join g on g.k = p.k and g.pa = p.pa group by p.k)
select m.conv_id, m.turn, m.role, case when nl.n > 0 then coalesce(tx.own, '') else m.text end as text, e.parent_turn, case when nq.n > 0 then coalesce(po.root_turn, m.turn) else m.turn end root_turn,
  case when nq.n > 0 then coalesce(len(po.path) - 1, 0) else 0 end::bigint depth, case when nq.n > 0 then coalesce(po.place, 0) else 0 end::bigint thread_position, coalesce(nq.n, 0)::bigint n_quoted, coalesce(nl.n, 0)::bigint n_linked
from m left join e on e.k = m.k left join po on po.conv_id = m.conv_id and po.turn = m.turn left join nq on nq.k = m.k left join nl on nl.k = m.k left join tx on tx.k = m.k"""
ORACLE_SQL = {"op7_quotes": _INPUT + _LINKED, "planted_quotes": _PLANTED + _LINKED}
