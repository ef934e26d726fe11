"""Chat formatting with loss masks aligned by character offsets.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Control strings inside
roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so the text can be restored exactly. The whole
conversation is rendered and encoded once; the markers are special tokens, so
no token crosses from a marker into a text. A token belongs to the turn in
whose text span its offset falls, found by binary search in the sorted spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pandekt.llm.common import released, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKERS = (TURN, TEXT, END)
#: Strings that this or other common templates give a meaning.
CONTROL = (*MARKERS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL_RE = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED_RE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Double backslashes, then break every control string, until none is left."""
    text = text.replace("\\", "\\\\")
    while True:
        broken = _CONTROL_RE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if broken == text:
            return text
        text = broken


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one was put in to break a control string."""
    return _ESCAPED_RE.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """Formatted conversation and the (start, end) of every turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation, texts unescaped."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, rest = turn.partition(TEXT)
        if not rest.endswith(END):
            raise ValueError("a turn isn't closed")
        out.append((unescape(role), unescape(rest[:-len(END)])))
    return out


def chat_tokenizer(path: str):
    """The public vocabulary with the markers as special tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

    t = Tokenizer.from_file(path)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKERS])
    return t


def token_turns(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Turn whose text holds each token, -1 outside texts. Spans are sorted and disjoint."""
    if not len(spans) or not len(offsets):
        return np.full(len(offsets), -1, dtype=np.int64)
    turn = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    inside = (turn >= 0) & (offsets[:, 0] < spans[np.maximum(turn, 0), 1]) & (offsets[:, 1] <= spans[np.maximum(turn, 0), 1]) & (offsets[:, 1] > offsets[:, 0])
    return np.where(inside, turn, -1)


def masked_texts(ids: list[int], mask: np.ndarray, decode) -> list[str]:
    """Unescaped text of every run of masked tokens, in order."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [unescape(decode(ids[a:b])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


_tokenizers: dict[str, object] = {}


def format_conversations(rows: DataFrame, tokenizer_path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, loss_mask (0 or 1 per id).

    Turns follow ``turn`` (nulls first), ties by role and text; repeated rows
    are turns of their own. Null roles and texts are empty. Rows with a null
    conv_id form one conversation. Roles are compared exactly. Other columns
    are ignored. An empty table gives no rows. A conversation is the unit of
    formatting and is rendered by one task; conversations are spread by id.
    """
    one = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    small_batches(rows.sparkSession)
    wanted = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = chat_tokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns = [[(t["role"], t["text"]) for t in c] for c in part.column("turns").to_pylist()]
                rendered = [render(c) for c in turns]
                ids, masks = [], []
                for c, (_, spans), enc in zip(turns, rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                    learn = np.array([r in wanted for r, _ in c] + [False])
                    owner = token_turns(np.array(enc.offsets, dtype=np.int64).reshape(-1, 2), spans)
                    ids.append(enc.ids)
                    masks.append(learn[owner].astype(np.int8))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([r[0] for r in rendered], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                                                 names=["conv_id", "formatted", "input_ids", "loss_mask"])

    return whole.mapInArrow(released(run), "conv_id long, formatted string, input_ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text, the ids and the mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = chat_tokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        decode = lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
        for batch in batches:
            n_turns, turns_sha, loss_chars, loss_sha, chars = [], [], [], [], []
            for whole, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("formatted", "input_ids", "loss_mask")), strict=True):
                turns = parse(whole)
                learned = "".join(masked_texts(ids, np.array(mask, dtype=np.int8), decode))
                n_turns.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss_chars.append(len(learned))
                loss_sha.append(hashlib.sha256(learned.encode()).hexdigest())
                chars.append(len(whole))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n_turns, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(loss_chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(chars, pa.int64())],
                                             names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(released(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
