"""Chat formatting at the level of tokens.

Each segment (role, text) is escaped and encoded alone, reserved ids beyond the vocabulary are spliced in as marks of
turns, and the loss mask is the running sum of +1 where an assistant's text begins and -1 where it ends. Control strings
occurring inside a role or text get a backslash after their first character, and backslashes are doubled, so that decoding
and taking the escapes out gives the text back exactly. A turn is a row, so a conversation of any length streams through.

Defined results: turns are ordered by number, ties by role and text; null roles and texts are empty; rows without a
conversation form one; repeated rows are turns of their own; a very long turn is one turn; other columns aren't
read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .tokens import vocabulary

#: The marks of the template, and the ids they have beyond the vocabulary's 50,257.
MARKS = {"<s>": 50257, "<|turn|>": 50258, "<|text|>": 50259, "<|end|>": 50260}
BEGIN, TURN, TEXT, OVER = MARKS.values()
#: Strings that some chat template or tokenizer reads as control.
FOREIGN = ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<unk>", "<pad>")
CONTROL = "|".join(map(re.escape, (*MARKS, *FOREIGN)))
_ESCAPE, _UNESCAPE = re.compile(rf"\\|{CONTROL}"), re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@cache
def _id_bytes(path: str) -> list[bytes]:
    own = {c: b for b, c in enumerate(byte_symbols())}
    t = _tokenizer(path)
    return [bytes(own[c] for c in t.id_to_token(i)) if i < 50256 else t.id_to_token(i).encode() for i in range(t.get_vocab_size())]


def assembled(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn_no (from 0), ids, mask: a row a turn, a conversation's rows in order within one partition."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches):
        import pyarrow as pa

        tokenizer, conv, n = _tokenizer(path or vocabulary("byte_bpe_50k.json")), object(), 0
        for b in batches:
            keys, roles, texts = (c.to_pylist() for c in b.columns)
            for at in range(0, len(keys), 512):
                part = slice(at, at + 512)
                heads = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch([escape(r) for r in roles[part]], add_special_tokens=False)]
                bodies = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch([escape(t) for t in texts[part]], add_special_tokens=False)]
                out: list[tuple] = []
                for key, role, head, body in zip(keys[part], roles[part], heads, bodies, strict=True):
                    n = n + 1 if key == conv else 0
                    conv = key
                    ids = np.concatenate([[BEGIN] * (n == 0) + [TURN], head, [TEXT], body, [OVER]]).astype(np.int32)
                    step = np.zeros(len(ids) + 1, np.int8)
                    if role == "assistant":
                        step[len(ids) - 1 - len(body)] += 1
                        step[len(ids) - 1] -= 1
                    out.append((key, n, ids, np.cumsum(step[:-1], dtype=np.int8)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32())), pa.array([x[3] for x in out], pa.list_(pa.int8()))], names=["conv_id", "turn_no", "ids", "mask"])

    return rows.mapInArrow(run, "conv_id long, turn_no long, ids array<int>, mask array<tinyint>")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """What the ids and masks of ``assembled`` say of each conversation; its rows must come in order."""
    names = {v: k for k, v in MARKS.items()}

    def run(batches):
        import pyarrow as pa

        table, conv, d = _id_bytes(path or vocabulary("byte_bpe_50k.json")), None, None

        def row():
            return (conv, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars)

        def decode(ids: np.ndarray) -> str:
            return b"".join([table[i] for i in ids.tolist()]).decode()

        for b in batches:
            out = []
            values, bounds = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            masks = b.column(3).values.to_numpy()
            for k, (key, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if n == 0:
                    if d is not None:
                        out.append(row())
                    conv, d = key, _Digest()
                ids, mask = values[bounds[k] : bounds[k + 1]], masks[bounds[k] : bounds[k + 1]] == 1
                marks = np.flatnonzero(ids >= BEGIN)
                d.chars += sum(len(names[i]) for i in ids[marks].tolist())
                turn, text, over = marks[-3:]
                role, body, loss = decode(ids[turn + 1 : text]), decode(ids[text + 1 : over]), unescape(decode(ids[mask]))
                d.chars += len(role) + len(body)
                d.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                d.n, d.loss_chars = d.n + 1, d.loss_chars + len(loss)
                d.loss.update(loss.encode())
            yield _rows(pa, out)
        if d is not None:
            yield _rows(pa, [row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(pa, out: list[tuple]):
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))
