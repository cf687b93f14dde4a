"""Chat formatting with a grammar round trip.

conversation := turn* ; turn := START role NEWLINE text END NEWLINE. A deterministic parser reads the rendered
text back; a turn whose recovered role or text differs from its source, or whose text holds a control string of
the template, is escaped, and the whole conversation must then parse to exactly its source turns.

Escaping puts a backslash after the first character of a control string, and one more where backslashes stand
there already, so it is reversible for every text. Roles are always escaped (they also hide newlines).

Defined results: null roles and texts are empty strings; turns are ordered by turn (nulls first), then role,
then text, and repeated rows are kept; a null conv_id is a conversation of its own; an empty table gives an
empty result; other columns are ignored. A conversation is one string, so its turns meet in one task; memory
is bounded by the longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Control strings of common chat templates; none may stay bare inside a text.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_role: str = "assistant"
    _any: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        alternatives = (rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in self.control)
        object.__setattr__(self, "_any", re.compile("|".join(alternatives)))

    def escape(self, text: str) -> str:
        return self._any.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._any.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def role_out(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def role_in(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(text))

    def parse(self, out: str) -> list[tuple[str, str, int, int]]:
        """Turns of a rendered conversation: role, text, and where the (escaped) text stands. ValueError if it doesn't parse."""
        turns, at = [], 0
        while at < len(out):
            if not out.startswith(self.start, at):
                raise ValueError(f"no turn at {at}")
            line = out.index("\n", at)
            stop = out.index(self.end, line + 1)
            if out[stop + len(self.end) : stop + len(self.end) + 1] != "\n":
                raise ValueError(f"text after the turn that ends at {stop}")
            turns.append((self.role_in(out[at + len(self.start) : line]), self.unescape(out[line + 1 : stop]), line + 1, stop))
            at = stop + len(self.end) + 1
        return turns

    def _reads_back(self, out: str, turns: list[tuple[str, str]]) -> bool:
        try:
            return [t[:2] for t in self.parse(out)] == turns
        except ValueError:
            return False

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, int]:
        """The rendered conversation and the number of escaped turns."""
        parts, escaped = [], 0
        for role, text in turns:
            bare = f"{self.start}{self.role_out(role)}\n{text}{self.end}\n"
            if any(c in text for c in self.control) or not self._reads_back(bare, [(role, text)]):
                bare = f"{self.start}{self.role_out(role)}\n{self.escape(text)}{self.end}\n"
                escaped += 1
            parts.append(bare)
        out = "".join(parts)
        if not self._reads_back(out, turns):
            raise ValueError("a conversation does not survive the round trip")
        return out, escaped


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>, n_escaped long"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: the formatted string, the spans under the loss mask (code points), escaped turns."""
    template = template or Template()
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"conv_id": batch.column(0).to_pylist(), "formatted": [], "loss_spans": [], "n_escaped": []}
            for source in batch.column(1).to_pylist():
                out, escaped = template.render([(t["role"] or "", t["text"] or "") for t in source])
                rows["formatted"].append(out)
                rows["loss_spans"].append([{"start": a, "stop": b} for role, _, a, b in template.parse(out) if role == template.loss_role])
                rows["n_escaped"].append(escaped)
            kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    return turns.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what the formatted strings and their loss spans hold."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = []
            for conv, out, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_spans"))):
                turns = template.parse(out)
                loss = "".join(template.unescape(out[s["start"] : s["stop"]]) for s in spans)
                rows.append((conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t, *_ in turns)), len(loss), hexed(loss), len(out)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: control strings in both texts.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


def _sql_escape(column: str) -> str:
    for c in Template().control:
        head, tail = (re.sub(r"([|\[\]])", r"\\\1", part) for part in (c[0], c[1:]))
        column = f"regexp_replace({column}, '({head})(\\\\*)({tail})', '\\1\\2\\\\\\3', 'g')"
    return column


OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length({_sql_escape("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1 + length({_sql_escape("text")}) + 11)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
