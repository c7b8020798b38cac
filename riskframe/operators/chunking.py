"""Front matter and the paragraph-packing chunker, as folds inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import content_hash
from riskframe.functions.text import WS, let, lstrip_ws, rstrip_ws, strip_ws
from riskframe.limits import CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP, CHUNK_TARGET

_REST = 2**31 - 1
_GAP = "\n\n"


def strip_front_matter(text: Column) -> Column:
    """Without a leading block between ``---`` lines; unchanged if the block is not closed."""

    def cut(t: Column) -> Column:
        close = F.locate("\n---", t, 4)
        tail = F.substring(t, close + F.lit(4), F.lit(_REST))
        rest = F.when(F.instr(tail, "\n") == 0, F.lit("")).otherwise(
            F.substring(tail, F.instr(tail, "\n") + F.lit(1), F.lit(_REST))
        )
        return F.when(t.startswith("---") & (close > 0), rest)

    return F.coalesce(let(lstrip_ws(text), cut), text)


def parse_front_matter(text: Column) -> Column:
    """ARRAY<STRUCT<key, kind, value, items>> of the block's ``key: value`` lines.

    ``kind`` is list, string, integer or bare; NULL without a front-matter block.
    """
    block = F.regexp_extract(text, r"(?s)\A---[\t ]*\n(.*?)\n---[\t ]*\n", 1)
    lines = F.filter(
        F.transform(F.split(block, "\n"), strip_ws),
        lambda x: (x != "") & ~x.startswith("#") & x.contains(":"),
    )

    def unquote(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(v, r"\A\"+|\"+\z", ""), r"\A'+|'+\z", "")

    def field(line: Column) -> Column:
        key = strip_ws(F.regexp_extract(line, r"(?s)\A([^:]*):", 1))
        raw = strip_ws(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))

        def typed(v: Column) -> Column:
            inner = F.substring(v, F.lit(2), F.char_length(v) - 2)
            is_list = v.rlike(r"(?s)\A\[.*\]\z")
            is_text = v.rlike(r"(?s)\A(?:\".*\"|'.*')\z")
            items = F.transform(
                F.filter(F.transform(F.split(inner, ","), strip_ws), lambda i: i != ""), unquote
            )
            kind = (
                F.when(is_list, "list").when(is_text, "string").when(v.rlike(r"\A\p{Nd}+\z"), "integer").otherwise("bare")
            )
            return F.struct(
                key.alias("key"),
                kind.alias("kind"),
                F.when(is_list, F.lit(None)).when(is_text, inner).otherwise(v).alias("value"),
                F.when(is_list, items).alias("items"),
            )

        return let(raw, typed)

    return F.when(text.rlike(r"(?s)\A---[\t ]*\n(.*?)\n---[\t ]*\n"), F.transform(lines, field))


def split_long(text: Column, size: int = CHUNK_TARGET) -> Column:
    """Slices of ``size`` characters."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.char_length(text), F.lit(1)) - 1) / size).cast("int")),
        lambda i: F.substring(text, i * size + 1, F.lit(size)),
    )


def _paragraphs(text: Column) -> Column:
    """ARRAY<STRUCT<off, text>>: stripped paragraphs with their place in the normalised
    text, the places from running lengths rather than from searching."""
    gap = rf"\n[{WS}]*\n"
    flat = strip_ws(F.regexp_replace(text, "[ \t]{2,}|\t", " "))

    def cut(t: Column) -> Column:
        return F.struct(
            F.split(t, gap, -1).alias("pieces"), F.regexp_extract_all(t, F.lit(gap), F.lit(0)).alias("gaps")
        )

    def places(c: Column) -> Column:
        sized = F.transform(
            c["pieces"],
            lambda p, i: F.struct(
                p.alias("raw"),
                (F.char_length(p) + F.coalesce(F.char_length(F.get(c["gaps"], i)), F.lit(0))).alias("step"),
            ),
        )
        state = F.struct(
            F.lit(0).alias("cursor"),
            F.array().cast("array<struct<off:int,text:string>>").alias("out"),
        )

        def step(acc: Column, p: Column) -> Column:
            lead = F.char_length(p["raw"]) - F.char_length(lstrip_ws(p["raw"]))
            para = F.struct((acc["cursor"] + lead).alias("off"), strip_ws(p["raw"]).alias("text"))
            return F.struct(
                (acc["cursor"] + p["step"]).alias("cursor"), F.array_append(acc["out"], para).alias("out")
            )

        return F.filter(F.aggregate(sized, state, step)["out"], lambda p: p["text"] != "")

    return let(let(flat, cut), places)


def chunks(
    text: Column,
    target: int = CHUNK_TARGET,
    maximum: int = CHUNK_MAX,
    minimum: int = CHUNK_MIN,
    overlap: int = CHUNK_OVERLAP,
    strict: bool = True,
) -> Column:
    """ARRAY<STRUCT<off, text>> of packed paragraphs.

    ``strict``: no chunk is longer than ``maximum`` (a paragraph that is too long is cut into slices
    first) and no chunk repeats only the overlap of the one before. Without it a paragraph that meets
    an empty buffer is one chunk whatever its length, and a last overlap is a chunk of its own.

    Paragraphs are packed up to ``maximum`` characters and shipped from ``target`` on,
    the last ``overlap`` characters opening the next chunk. When the next paragraph does
    not fit, a buffer of ``minimum`` is shipped; a smaller one is topped up with slices
    of that paragraph. A paragraph that meets an empty buffer is taken whole.
    """
    kind = "array<struct<off:int,text:string>>"

    def state(out: Column, buf: Column, off: Column) -> Column:
        return F.struct(out.cast(kind).alias("out"), buf.alias("buf"), off.cast("int").alias("off"))

    def emit(acc: Column, text_: Column) -> Column:
        return F.array_append(acc["out"], F.struct(acc["off"].alias("off"), text_.alias("text")))

    def step(acc: Column, para: Column) -> Column:
        buf, size = acc["buf"], F.char_length(acc["buf"])
        joined_size = size + len(_GAP) + F.char_length(para["text"])
        joined = F.concat(buf, F.lit(_GAP), para["text"])

        def pack() -> Column:
            return let(
                joined,
                lambda whole: F.when(
                    joined_size >= target,
                    state(
                        emit(acc, whole),
                        F.right(whole, F.lit(overlap)),
                        acc["off"] + joined_size - F.least(joined_size, F.lit(overlap)),
                    ),
                ).otherwise(state(acc["out"], whole, acc["off"])),
            )

        def flush() -> Column:
            return let(
                F.right(buf, F.lit(overlap)),
                lambda tail: state(
                    emit(acc, buf),
                    F.when(strip_ws(tail) != "", F.concat(tail, F.lit(_GAP), para["text"])).otherwise(para["text"]),
                    para["off"] - F.char_length(tail),
                ),
            )

        def top_up() -> Column:
            def add(inner: Column, piece: Column) -> Column:
                fits = (inner["buf"] != "") & (
                    F.char_length(inner["buf"]) + F.char_length(piece) + len(_GAP) <= maximum
                )
                return F.when(
                    fits, state(inner["out"], F.concat(inner["buf"], F.lit(_GAP), piece), inner["off"])
                ).otherwise(
                    state(
                        F.when(inner["buf"] != "", emit(inner, inner["buf"])).otherwise(inner["out"]),
                        piece,
                        para["off"],
                    )
                )

            return F.aggregate(split_long(para["text"], target), acc, add)

        return (
            F.when(size == 0, state(acc["out"], para["text"], para["off"]))
            .when(joined_size <= maximum, pack())
            .when(size >= minimum, flush())
            .otherwise(top_up())
        )

    start = state(F.array(), F.lit(""), F.lit(0))

    def finish(acc: Column) -> Column:
        def close(rest: Column) -> Column:
            wanted = rest != ""
            if strict:
                last = F.element_at(acc["out"], -1)["text"]
                only_overlap = (F.size(acc["out"]) > 0) & (F.char_length(rest) <= overlap) & last.endswith(rest)
                wanted = wanted & ~F.coalesce(only_overlap, F.lit(False))
            return F.when(wanted, emit(acc, rest)).otherwise(acc["out"])

        return let(strip_ws(acc["buf"]), close)

    paragraphs = _paragraphs(text)
    if strict:
        room = maximum - overlap - len(_GAP)
        paragraphs = F.flatten(
            F.transform(
                paragraphs,
                lambda p: F.transform(
                    split_long(p["text"], room), lambda s, i: F.struct((p["off"] + i * room).alias("off"), s.alias("text"))
                ),
            )
        )
    return F.aggregate(paragraphs, start, step, finish)


# --- the strict chunker: a fold over lengths -----------------------------------------------------------------
#
# The paragraphs, joined by gaps, are one text T. A buffer is a stretch of T, [a, b), but for one gap that may be put
# in at g, between two slices of a paragraph, and for ``nl`` newlines in front, what is left of such a gap in an
# overlap. So the fold over paragraphs carries numbers, and texts are cut out of T once, at its end.

_BLOCK, _GROUP = 4096, 256


def _trailing(text: Column) -> Column:
    return F.char_length(text) - F.char_length(rstrip_ws(text))


def _pieces(text: Column, room: int) -> Column:
    """ARRAY<STRUCT<lead, step, len, white, text>>: slices of at most ``room`` characters of the stripped paragraphs. ``lead`` is
    how far after the cursor a slice begins, ``step`` how far the cursor goes on behind it, ``white`` its white space at the end."""
    gap = rf"\n[{WS}]*\n"
    flat = strip_ws(F.regexp_replace(text, "[ \t]{2,}|\t", " "))

    def cut(t: Column) -> Column:
        return F.struct(F.split(t, gap, -1).alias("raw"), F.regexp_extract_all(t, F.lit(gap), F.lit(0)).alias("gaps"))

    def slices(c: Column) -> Column:
        def of(raw: Column, i: Column) -> Column:
            step = F.char_length(raw) + F.coalesce(F.char_length(F.get(c["gaps"], i)), F.lit(0))
            lead = F.char_length(raw) - F.char_length(lstrip_ws(raw))

            def sized(parts: Column) -> Column:
                last = F.size(parts) - 1
                return F.transform(parts, lambda s, j: F.struct((lead + j * room).cast("int").alias("lead"), F.when(j == last, step).otherwise(0).cast("int").alias("step"), F.char_length(s).alias("len"), _trailing(s).alias("white"), s.alias("text")))

            return let(split_long(strip_ws(raw), room), sized)

        return F.flatten(F.transform(c["raw"], of))

    return let(let(flat, cut), slices)


def _stretch(blocks: Column, a: Column, b: Column) -> Column:
    """T[a:b) from its blocks of a fixed length: the cost follows from the stretch and not from the text."""
    first = F.floor(a / _BLOCK).cast("int")
    inside = F.array_join(F.slice(blocks, first + 1, F.floor((F.greatest(b, a + 1) - 1) / _BLOCK).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(inside, a - first * _BLOCK + 1, b - a)).otherwise(F.lit(""))


def _text_of(blocks: Column, c: Column) -> Column:
    plain = _stretch(blocks, c["a"], c["b"])
    split = F.concat(_stretch(blocks, c["a"], c["g"]), F.lit(_GAP), _stretch(blocks, c["g"], c["b"]))
    return F.concat(F.repeat(F.lit("\n"), c["nl"]), F.when(c["g"] < 0, plain).otherwise(split))


def strict_chunks(text: Column, target: int = CHUNK_TARGET, maximum: int = CHUNK_MAX, minimum: int = CHUNK_MIN, overlap: int = CHUNK_OVERLAP) -> Column:
    """The strict form of :func:`chunks`, in time that grows with the text's length."""
    gap, room = len(_GAP), maximum - overlap - len(_GAP)

    def state(acc: Column, **new: Column | int) -> Column:
        """``acc`` with some fields new."""
        names = ("out", "cur", "pos", "nl", "a", "g", "b", "w", "off")
        whole = [(F.lit(new[n]) if isinstance(new[n], int) else new[n]) if n in new else acc[n] for n in names]
        return F.struct(*[(c if n == "out" else c.cast("int")).alias(n) for n, c in zip(names, whole)])

    def size(s: Column) -> Column:
        return s["nl"] + s["b"] - s["a"] + F.when(s["g"] >= 0, gap).otherwise(0)

    def emitted(s: Column) -> Column:
        return F.array_append(s["out"], F.struct(s["off"].alias("off"), s["nl"].alias("nl"), s["a"].alias("a"), s["g"].alias("g"), s["b"].alias("b")))

    def tail(s: Column) -> Column:
        """The state's buffer cut to its last ``overlap`` characters."""
        behind = s["b"] - s["g"]
        kept = F.least(size(s), F.lit(overlap))
        return (
            F.when(size(s) <= overlap, s)
            .when((s["g"] < 0) | (behind >= overlap), state(s, nl=0, a=s["b"] - overlap, g=-1, w=F.least(s["w"], kept)))
            .when(behind + gap >= overlap, state(s, nl=F.lit(overlap) - behind, a=s["g"], g=-1, w=F.least(s["w"], kept)))
            .otherwise(state(s, nl=0, a=s["b"] - (overlap - gap), w=F.least(s["w"], kept)))
        )

    def grown(s: Column, length: Column, white: Column, end: Column) -> Column:
        """The buffer with what comes next in T, behind a gap."""
        return state(s, b=end, w=F.when(white < length, white).otherwise(s["w"] + gap + length))

    def fold(acc: Column, p: Column) -> Column:
        at, start, n = acc["cur"] + p["lead"], acc["pos"], p["len"]
        end, whole = start + n, size(acc) + gap + n

        def pack() -> Column:
            def ship(s: Column) -> Column:
                return F.when(whole >= target, let(tail(s), lambda t: state(t, out=emitted(s), off=s["off"] + whole - F.least(whole, F.lit(overlap))))).otherwise(s)

            return let(grown(acc, n, p["white"], end), ship)

        def flush() -> Column:
            def go_on(t: Column) -> Column:
                held = size(t)
                fresh = state(t, nl=0, a=start, g=-1, b=end, w=p["white"])
                return state(F.when(t["w"] < held, grown(t, n, p["white"], end)).otherwise(fresh), out=emitted(acc), off=at - held)

            return let(tail(acc), go_on)

        def top_up() -> Column:
            """The paragraph in slices of ``target``: as ``room`` is less than twice that, there are two at most."""
            first = F.least(n, F.lit(target))
            rest = n - first
            head_white = _trailing(F.substring(p["text"], F.lit(1), first))
            fits = size(acc) + first + gap <= maximum
            one = F.when(fits, state(grown(acc, first, head_white, start + first), off=acc["off"])).otherwise(state(acc, out=emitted(acc), nl=0, a=start, g=-1, b=start + first, w=head_white, off=at))

            def second(s: Column) -> Column:
                more = size(s) + rest + gap <= maximum
                rest_white = F.least(p["white"], rest)
                joined = state(s, g=s["b"], b=end, w=F.when(rest_white < rest, rest_white).otherwise(s["w"] + gap + rest))
                alone = state(s, out=emitted(s), nl=0, a=start + first, g=-1, b=end, w=rest_white, off=at)
                return F.when(rest == 0, s).when(more, joined).otherwise(alone)

            return let(one, second)

        moved = (
            F.when(size(acc) == 0, state(acc, nl=0, a=start, g=-1, b=end, w=p["white"], off=at))
            .when(whole <= maximum, pack())
            .when(size(acc) >= minimum, flush())
            .otherwise(top_up())
        )
        following = F.when(p["step"] > 0, acc["cur"] + p["step"]).otherwise(acc["cur"])
        return F.when(n == 0, state(acc, cur=following)).otherwise(state(moved, cur=following, pos=end + gap))

    def cut(pieces: Column) -> Column:
        whole = F.array_join(F.filter(F.transform(pieces, lambda p: p["text"]), lambda t: t != ""), _GAP)
        return F.struct(pieces.alias("pieces"), F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"))

    start = F.struct(F.array().cast("array<struct<off:int,nl:int,a:int,g:int,b:int>>").alias("out"), *[F.lit(v).alias(n) for n, v in (("cur", 0), ("pos", 0), ("nl", 0), ("a", 0), ("g", -1), ("b", 0), ("w", 0), ("off", 0))])

    def told(c: Column) -> Column:
        def finish(s: Column) -> Column:
            shipped = F.transform(s["out"], lambda x: F.struct(x["off"].alias("off"), _text_of(c["blocks"], x).alias("text")))
            rest = strip_ws(_text_of(c["blocks"], s))

            def close(r: Column) -> Column:
                last = _text_of(c["blocks"], F.element_at(s["out"], -1))
                only_overlap = F.coalesce((F.size(s["out"]) > 0) & (F.char_length(r) <= overlap) & F.endswith(last, r), F.lit(False))
                return F.when((r != "") & ~only_overlap, F.array_append(shipped, F.struct(s["off"].alias("off"), r.alias("text")))).otherwise(shipped)

            return let(rest, close)

        # a fold copies its state at each step, so the chunks of a group of paragraphs are put aside when the group is done
        last = F.floor((F.greatest(F.size(c["pieces"]), F.lit(1)) - 1) / _GROUP).cast("int")
        groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(c["pieces"], g * _GROUP + 1, F.lit(_GROUP)))

        def group(acc: Column, pieces: Column) -> Column:
            none = F.array().cast("array<struct<off:int,nl:int,a:int,g:int,b:int>>")
            return let(F.aggregate(pieces, state(acc, out=none), fold), lambda s: state(s, out=F.concat(acc["out"], s["out"])))

        return let(F.aggregate(groups, start, group), finish)

    return let(let(_pieces(text, room), cut), told)


def chunk_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", chunker: Callable[[Column], Column] = strict_chunks
) -> DataFrame:
    """doc_id, chunk_no, chunk_id (``doc:0000``, four digits at least), chunk_text,
    chunk_offset, length, hash."""
    body = F.col("c.text")
    number = F.col("chunk_no").cast("string")
    return docs.select(key, F.posexplode(chunker(F.col(text))).alias("chunk_no", "c")).select(
        key,
        "chunk_no",
        F.concat_ws(
            ":", F.col(key).cast("string"), F.when(F.char_length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
        ).alias("chunk_id"),
        body.alias("chunk_text"),
        F.col("c.off").alias("chunk_offset"),
        F.char_length(body).alias("length"),
        content_hash(body).alias("hash"),
    )
