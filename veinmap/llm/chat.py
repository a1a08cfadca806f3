"""Chat formatting by schema fingerprints.

A record's fingerprint is the hash of its set of nested field paths.  It selects a declarative
mapping (the one with most required paths that the fingerprint's set holds; other paths may stand
beside them), which turns the record's layout (one message, a list of messages, a prompt with its
response, an instruction) into canonical turns.  What no mapping fits, or what a mapping would read
without one of its texts, is handed back as it is.  A template marks the turns and escapes its control
strings inside texts, so the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinmap.llm.common import map_rows

#: Names of the roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: In a path, an item of a list (keys are strings, so none can be taken for it).
ITEM = 0


@dataclass(frozen=True)
class Layout:
    """A mapping: the paths that a record must have, where its turns stand, and what they are made of.

    walk: the list of turns (None: the record itself).  turns: a role, or "@" and its key, and the
    keys of the text; a key after "?" may be absent or empty.  head: fields of the record that, if
    there, are turns of their own before the others: key and role.
    """

    name: str
    required: tuple[tuple, ...]
    walk: tuple | None
    turns: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...]
    head: tuple[tuple[str, str], ...] = (("system", "system"),)

    def read(self) -> set[str]:
        """Keys of the record that hold texts it reads."""
        own = {self.walk[0]} if self.walk else {p[0].lstrip("?") for _, texts in self.turns for p in texts}
        return own | {key for key, _ in self.head}


def _list(name: str, walk: tuple, role: str, text: str, *more) -> Layout:
    return Layout(name, ((*walk, ITEM, role), (*walk, ITEM, text, *more)), walk, ((f"@{role}", ((text,),)),))


def _pair(name: str, asked: tuple[str, ...], answered: str) -> Layout:
    return Layout(name, tuple((k,) for k in (*asked, answered) if k[0] != "?"), None, (("user", tuple((k,) for k in asked)), ("assistant", ((answered,),))))


LAYOUTS = (
    Layout("text message", (("role",), ("text",)), None, (("@role", (("text",),)),), ()),
    Layout("content message", (("role",), ("content",)), None, (("@role", (("content",),)),), ()),
    Layout("from-value message", (("from",), ("value",)), None, (("@from", (("value",),)),), ()),
    _list("messages", ("messages",), "role", "content"),
    _list("messages of parts", ("messages",), "role", "content", ITEM, "text"),
    _list("conversations", ("conversations",), "from", "value"),
    _list("list of messages", (), "role", "content"),
    _list("list of messages of parts", (), "role", "content", ITEM, "text"),
    _list("list of from and value", (), "from", "value"),
    _pair("prompt and response", ("prompt",), "response"),
    _pair("prompt and completion", ("prompt",), "completion"),
    _pair("instruction", ("instruction", "?input"), "output"),
    Layout("question and answer", (("data", "question"), ("data", "answer")), None, (("user", (("data", "question"),)), ("assistant", (("data", "answer"),)))),
)
#: Keys of a record, and of a turn in a list, that hold texts: a layout must read those that are filled.
TEXTS = frozenset({"system", "prompt", "response", "completion", "instruction", "input", "output", "messages", "conversations", "text", "content", "value"})
TURN_TEXTS = frozenset({"text", "content", "value"})

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ((?:\\.|[^\n])*)\n((?:\\\\|\\###|\\</turn>|(?!</turn>).)*)</turn>\n", re.S)


def paths(value, at: tuple = ()) -> set[tuple]:
    """Nested field paths: keys, and ITEM for the items of a list."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in paths(v, (*at, k))}
    if isinstance(value, list) and value:
        return {p for v in value for p in paths(v, (*at, ITEM))}
    return {at}


def fingerprint(found: set[tuple] | tuple[tuple, ...]) -> str:
    """Hash of a set of paths, each written as JSON, so that no two sets are written alike."""
    return hashlib.md5("\n".join(sorted(json.dumps(p) for p in found)).encode()).hexdigest()


@lru_cache(maxsize=1 << 14)
def _selected(key: str, found: frozenset[tuple]) -> Layout | None:
    fitting = [(len(layout.required), -i) for i, layout in enumerate(LAYOUTS) if found.issuperset(layout.required)]
    return LAYOUTS[-max(fitting)[1]] if fitting else None


def mapping_of(found: set[tuple]) -> Layout | None:
    """The layout that a set of paths selects: most required paths, the first among equals."""
    return _selected(fingerprint(found), frozenset(found))


def _get(value, path: tuple):
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    """A string as it is; the texts of a list of parts, each on its line; else JSON."""
    if isinstance(value, list) and all(isinstance(p, str) or isinstance(p, dict) for p in value):
        parts = [p if isinstance(p, str) else p.get("text") for p in value]
        return "\n".join(p if isinstance(p, str) else json.dumps(p) for p in parts if p is not None)
    return value if isinstance(value, str) else json.dumps(value)


def _plain(text: str) -> str:
    """Surrogates in pairs become the character they mean, lone ones U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _filled(value, keys: frozenset[str]) -> set[str]:
    return {k for k in keys if value.get(k) not in (None, "", [], {})} if isinstance(value, dict) else set()


def _turns(value, layout: Layout) -> list[tuple[str, str]] | None:
    """The turns of a record, or None if the layout would leave a text of it unread."""
    if _filled(value, TEXTS) - layout.read():
        return None
    out = [(role, _text(value[key])) for key, role in layout.head if isinstance(value, dict) and value.get(key) not in (None, "")]
    items = [value] if layout.walk is None else _get(value, layout.walk)
    for item in items:
        for role, texts in layout.turns:
            if role[0] == "@" and (not isinstance(item, dict) or role[1:] not in item):
                return None
            if layout.walk is not None and _filled(item, TURN_TEXTS) - {p[0] for p in texts}:
                return None
            who = str(_get(item, (role[1:],)) or "") if role[0] == "@" else role
            own = [(p[0][0] == "?", _get(item, (p[0].lstrip("?"), *p[1:]))) for p in texts]
            parts = [_text(t) for optional, t in own if t is not None and not (optional and t == "")]
            out.append((ROLES.get(who, who) if role == "@from" else who, "\n".join(parts)))
    return out


def canonical(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Name of the layout (null: none fits or would leave a text unread, no JSON, or nested too deeply) and the turns."""
    try:
        value = json.loads(record or "")
        layout = mapping_of(paths(value))
        turns = _turns(value, layout) if layout else None
    except (ValueError, RecursionError):
        return None, []
    if turns is None:
        return None, []
    return layout.name, [(_plain(role), _plain(text)) for role, text in turns]


def written(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The turns in the template, and the places of assistants' texts in it (the loss mask)."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head = OPEN + _CONTROL.sub(r"\\\g<0>", role).replace("\n", r"\n") + "\n"
        body = _CONTROL.sub(r"\\\g<0>", text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE + "\n")
        at += len(out[-1])
    return "".join(out), mask


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    role = lambda s: re.sub(r"\\(\\|###|</turn>|n)", lambda m: "\n" if m[1] == "n" else m[1], s)
    return [(role(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def formatted(records: DataFrame) -> DataFrame:
    """records (conv_id, seq, record: JSON) -> conv_id, seq, layout, formatted, mask, unmatched.

    mask: array of start, stop of the assistants' texts.  A record that no layout fits, that has a
    filled text field (TEXTS; TURN_TEXTS in a list's turns) which its layout doesn't read, or a turn
    without a role, that is no JSON or is nested too deeply has a null layout and an empty text, and
    stands in ``unmatched`` as it is (null for all others).  Other fields are left out.  A null role
    or text is empty.  The texts of a conversation's records, in order, follow each other.  Other
    columns are not looked at.  A very long record is held whole, some ten times its size.  Narrow:
    no shuffle.
    """

    def start():
        def step(conv_ids, seqs, all_records):
            found = [canonical(r) for r in all_records]
            made = [written(turns) for _, turns in found]
            lost = [r if name is None else None for r, (name, _) in zip(all_records, found, strict=True)]
            return [conv_ids, seqs, [name for name, _ in found], [text for text, _ in made], [[{"start": a, "stop": b} for a, b in mask] for _, mask in made], lost]

        return step

    return map_rows(records, ["conv_id", "seq", "record"], "conv_id long, seq long, layout string, formatted string, mask array<struct<start:int,stop:int>>, unmatched string", start)


def digests(texts: DataFrame) -> DataFrame:
    """Reads formatted texts back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's rows stream through one task in the order of ``seq`` (ties by text), with two
    running hashes as its only state, so its length is no matter of memory; a very long text of one
    record is held whole, a few times over.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def ended():
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in n else pa.int64()) for n, c in zip(names, zip(*done), strict=True)], names)

        for batch in batches:
            for conv_id, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != now:
                    if state:
                        ended()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read(text)
                state[0] += len(turns)
                state[1].update("".join(f"{role}\n{t}\n" for role, t in turns).encode())
                loss = "".join(unescaped(text[m["start"] : m["stop"]]) for m in mask)
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield batch_of()
                done.clear()
        if state:
            ended()
        if done:
            yield batch_of()

    rows = texts.select("conv_id", "seq", "formatted", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "formatted")
    return rows.select("conv_id", "formatted", "mask").mapInArrow(run, ddl)


#: The added conversation.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations (rows by turn: conv_id, turn, role, text) and of PROBE_ID's.

    Null texts and roles are empty; a null conv_id is a conversation of its own; rows of the same
    turn follow in the order of role and text; repeated rows are turns of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("seq"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, json.dumps({"prompt": PROBE, "response": PROBE}))], "conv_id long, seq long, record string")
    return digests(formatted(rows.unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS p(conv_id, turn, role, text)),
e AS (SELECT *, length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length(role) + 13 AS n FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
