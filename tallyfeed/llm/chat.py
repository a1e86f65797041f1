"""Chat formatting as a prefix tree of turns.

Each turn is rendered as ``<|turn|>role<|text|>text<|end|>``. Control strings
inside roles and texts are broken up by a backslash after their first character
(and backslashes doubled), which ``unescape`` reverts, so a marker in the output
is always the template's own. A turn's header, text and footer are encoded apart
by a byte-level tokenizer, so tokens of a shared turn are the same everywhere.

Conversations that begin with the same turns share those turns: a node of the
tree is a sequence of turns from the start. Its path is one string of ``STEP``
bytes for each turn, a digest of the turn and of what came before it, so a path
sorts right before its descendants and costs ``STEP`` bytes a turn. Each node
is emitted once; all nodes lie depth-first in one token stream (children follow
their parent, by digest), each with

- ``start``, ``stop``: its tokens' place in the stream,
- ``position``: the position id of its first token, counted along its own path,
- ``attend``: the stream intervals of its ancestors, root first, which with its
  own tokens (causally) are all that it may attend to,
- ``loss_from``, ``loss_to``: the part of its tokens under the loss mask (the
  text of an assistant turn).

After a node come the rows of the conversations that end there (kind ``end``),
whose ``attend`` covers the whole conversation. The order is a distributed sort
by path, written once to the shared folder with places that count from the start of
a partition; what came before one (tokens, open ancestors) follows from one small row
per partition and is added in a join on the partition's number, so neither a frequent
first turn nor copies of a conversation gather anywhere.

Null texts and roles are empty; rows of equal (conversation, turn) follow by role
and text; a null conv_id is one conversation; an empty table gives no rows; other
columns, of any name, are ignored. One
conversation's turns are gathered in one task, as its digest needs them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, produce

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What must not appear inside a text: openings of the template's markers, and those of other common templates.
_CONTROL = r"(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])"
#: Bytes of a path for each turn: siblings collide with probability 1e-11 among a billion.
STEP = 12
_INTERVALS = "array<struct<start: bigint, stop: bigint>>"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), _CONTROL, r"$1$3\\$2$4")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


#: The encoder of this process: later tasks of a worker find it loaded.
_LOADED: list = []


def _encoder():
    if not _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED.append(tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _LOADED[0]


def _encode(roles, texts, learn):
    import numpy as np

    enc = _encoder().encode_ordinary
    end, ids, lo, hi, n = enc(END), [], [], [], []
    for role, text, use in zip(roles, texts, learn, strict=True):
        head, body = enc(TURN + role + TEXT), enc(text)
        ids.append(np.array(head + body + end, "<u4").tobytes())
        lo.append(len(head))
        hi.append(len(head) + len(body) * use)
        n.append(len(head) + len(body) + len(end))
    return ids, lo, hi, n


def _place(batches):
    """Rows sorted by path, placed from the start of their partition; then a row about its borders (kind ``border``).

    ``outside`` counts a row's ancestors that opened before the partition, which are its first ones.
    """
    from pyspark import TaskContext

    part, at, stack, seen = TaskContext.get().partitionId(), 0, [], False
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in ("path", "n", "conv_id", "ids", "loss_from", "loss_to")}
        out = {n: [] for n in ("start", "stop", "outside", "attend")}
        for path, n in zip(cols["path"], cols["n"], strict=True):
            depth = len(path) // STEP - (n is not None)
            del stack[depth:]
            stack += [None] * (depth - len(stack))
            outside = stack.count(None)
            out["outside"].append(outside)
            out["attend"].append([{"start": s, "stop": s + m} for s, m in stack[outside:]])
            out["start"].append(at)
            out["stop"].append(at + (n or 0))
            if n is not None:
                stack.append((at, n))
                at += n
        seen = True
        yield {"part": [part] * b.num_rows, "kind": ["end" if n is None else "turn" for n in cols["n"]], "node": [p[-STEP:].hex() for p in cols["path"]], **{n: cols[n] for n in ("conv_id", "ids", "loss_from", "loss_to")}, **out}
    if seen:
        outside = stack.count(None)
        yield {"part": [part], "kind": ["border"], "start": [0], "stop": [at], "outside": [outside], "attend": [[{"start": s, "stop": s + m} for s, m in stack[outside:]]]} | {n: [None] for n in ("node", "conv_id", "ids", "loss_from", "loss_to")}


def prefix_tree(conversations: DataFrame) -> DataFrame:
    """The token stream: kind, node, conv_id, ids (binary, unsigned 32-bit little-endian), loss_from, loss_to, start, stop, position, attend."""
    spark = conversations.sparkSession
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    told = lambda path, t: F.concat_ws("|", F.hex(F.substring(path, -STEP, STEP)), F.length(t["role"]).cast("string"), t["role"], t["text"])
    step = lambda path, t: F.concat(path, F.substring(F.unhex(F.sha2(told(path, t), 256)), 1, STEP))
    paths = turns.withColumn("path", F.aggregate("turns", F.lit(b""), step))
    each = paths.select("path", F.posexplode("turns").alias("i", "t")).select(F.substring("path", F.lit(1), STEP * (F.col("i") + 1)).alias("path"), "t.role", "t.text")
    nodes = each.dropDuplicates(["path"]).select("path", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), (F.col("role") == "assistant").alias("learn"))
    nodes = map_rows(nodes, _encode, "ids binary, loss_from bigint, loss_to bigint, n bigint", ["r", "t", "learn"], ["path"])
    ends = paths.select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("loss_from", "bigint"), ("loss_to", "bigint"), ("n", "bigint"))], "conv_id")
    rows = nodes.withColumn("conv_id", F.lit(None).cast(id_type)).unionByName(ends).withColumn("rank", F.col("n").isNull().cast("int"))
    order = ["path", "rank", "conv_id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("path", "n", "conv_id", "ids", "loss_from", "loss_to")
    out = f"part int, kind string, node string, conv_id {id_type}, ids binary, loss_from bigint, loss_to bigint, start bigint, stop bigint, outside int, attend {_INTERVALS}"
    done = materialize(produce(placed, _place, out), "chat-stream")
    # a row a partition: its tokens, and the ancestors that are open at its end
    base, stack, carried = 0, [], []
    for r in done.where("kind = 'border'").select("part", "stop", "outside", "attend").orderBy("part").collect():
        carried.append((r["part"], base, list(stack)))
        stack = stack[: r["outside"]] + [(base + x["start"], base + x["stop"]) for x in r["attend"]]
        base += r["stop"]
    before = spark.createDataFrame(carried, f"part int, base bigint, open {_INTERVALS}")
    moved = F.transform("attend", lambda x: F.struct((x["start"] + F.col("base")).alias("start"), (x["stop"] + F.col("base")).alias("stop")))
    placed = done.where("kind <> 'border'").join(F.broadcast(before), "part").withColumn("attend", F.concat(F.slice("open", F.lit(1), F.col("outside")), moved))
    position = F.aggregate("attend", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return placed.select("kind", "node", "conv_id", "ids", "loss_from", "loss_to", (F.col("start") + F.col("base")).alias("start"), (F.col("stop") + F.col("base")).alias("stop"), position.alias("position"), "attend")


def _decode(ids, lo, hi):
    import numpy as np

    decode = _encoder().decode_bytes
    whole, masked = [], []
    for x, a, b in zip(ids, lo, hi, strict=True):
        x = np.frombuffer(x, "<u4").tolist()
        whole.append(decode(x).decode())
        masked.append(decode(x[a:b]).decode())
    return whole, masked


def read_back(stream: DataFrame) -> DataFrame:
    """From a token stream: conv_id, turns (array of role, text; unescaped), formatted, masked (array of texts under the loss mask, unescaped)."""
    texts = map_rows(stream.where("kind = 'turn'"), _decode, "formatted string, masked string", ["ids", "loss_from", "loss_to"], ["start", "loss_from", "loss_to"])
    parts = stream.where("kind = 'end'").select("conv_id", F.explode("attend").alias("x")).select("conv_id", F.col("x.start").alias("start"))
    found = parts.join(texts, "start").select("conv_id", F.struct("start", "formatted", F.when(F.col("loss_to") > F.col("loss_from"), F.col("masked")).alias("masked")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    inner = lambda p: F.substring(p["formatted"], len(TURN) + 1, F.length(p["formatted"]) - len(TURN + END))
    turn = lambda p: F.struct(unescape(F.substring_index(inner(p), TEXT, 1)).alias("role"), unescape(F.substring(inner(p), F.instr(inner(p), F.lit(TEXT)) + len(TEXT), F.length(inner(p)))).alias("text"))
    return found.select("conv_id", F.transform("p", turn).alias("turns"), F.array_join(F.transform("p", lambda p: p["formatted"]), "").alias("formatted"), F.transform(F.filter("p", lambda p: p["masked"].isNotNull()), lambda p: unescape(p["masked"])).alias("masked"))
