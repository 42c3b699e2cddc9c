"""Chunkers: one size-guarded document to many chunk rows, parallel by row.

Each chunker is a fold over the document's sentences. The fold keeps sentence
counts and lengths, not text, and puts its chunks out as it goes (``fold_out``);
a chunk's text is joined from its slice of the sentence array at the end. So the
work grows with the document's length. There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules as R
from ..functions.text import (
    any_of, contains_any, fold_out, let, sentences, starts_with_any, strip, word_count,
)

SPAN = ("first", "n")


def _with(done: Column, first: Column, n: Column) -> Column:
    return F.concat(done, F.array(F.struct(first.alias("first"), n.alias("n"))))


def _joined(span: Column) -> Column:
    """The span's sentences, joined by one space."""
    return F.array_join(F.slice("sents", span["first"], span["n"]), " ")


def _cut(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


# --- sentence sizes ------------------------------------------------------------


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: key, sentence_index, sentence."""
    return df.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_index", "sentence"))


def chunk_profile(text: Column, max_size: int = R.MAX_CHARS, overlap: int = R.OVERLAP_CHARS) -> Column:
    """Struct(target, max, min, overlap) from line length, dialogue share and paragraph breaks."""
    line_count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    mean_line = (F.length(text) - line_count + 1) / line_count
    quotes = F.regexp_count(text, F.lit('"[^"]*"'))
    dialogue = F.when(quotes > 0, quotes / F.greatest(word_count(text), F.lit(1))).otherwise(0.0)
    breaks = F.floor((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2)

    def sizes(talk):
        target = (
            F.when(talk > 0.1, int(R.TARGET_CHARS * 0.8))
            .when(mean_line > 100, int(R.TARGET_CHARS * 1.2))
            .when(breaks > line_count * 0.3, int(R.TARGET_CHARS * 1.1))
            .otherwise(R.TARGET_CHARS)
        )
        return F.struct(
            target.cast("int").alias("target"),
            F.lit(max_size).alias("max"),
            F.lit(R.MIN_CHARS).alias("min"),
            F.when(talk > 0.1, int(overlap * 1.2)).otherwise(overlap).cast("int").alias("overlap"),
        )

    return let(dialogue, sizes)


# --- C3, C4: packing by size ------------------------------------------------------


def chunk_greedy(df: DataFrame, key: str, text: str, max_size: int = R.GREEDY_MAX, overlap: int = R.GREEDY_OVERLAP) -> DataFrame:
    """Pack sentences up to a size; the next chunk starts with the last characters of this one."""
    span = lambda a: F.array(F.struct((a["at"] - a["own"]).alias("first"), a["own"].alias("n")))

    def state(at, own, size, tail, done):
        return F.struct(at.alias("at"), own.alias("own"), size.alias("size"), tail.alias("tail"), done.alias("done"))

    zero = {"at": F.lit(1), "own": F.lit(0), "size": F.lit(0), "tail": F.lit(0)}

    def step(a, sentence):
        n, at = F.length(sentence), a["at"] + 1
        tail = F.least(F.when(a["at"] > 1, a["tail"] + 1 + n).otherwise(n), F.lit(overlap))
        return F.when(
            (a["own"] > 0) & (a["size"] + n > max_size), state(at, F.lit(1), a["tail"] + 1 + n, tail, span(a))
        ).otherwise(state(at, a["own"] + 1, a["size"] + n, tail, a["done"]))

    spans = fold_out("sents", zero, SPAN, step, lambda a: F.concat(a["done"], span(a)))
    packed = df.select(key, sentences(F.col(text)).alias("sents")).filter(F.size("sents") > 0)

    def content(span):
        """The span after the last characters of what stands before it, which no more than ``overlap`` sentences hold."""
        from_ = F.greatest(span["first"] - max(overlap, 1), F.lit(1))
        head = F.right(F.array_join(F.slice("sents", from_, span["first"] - from_), " "), F.lit(overlap))
        return strip(F.when(head != "", F.concat(head, F.lit(" "), _joined(span))).otherwise(_joined(span)))

    # joined inside the row: exploded spans would carry all sentences with every chunk
    return packed.select(key, F.posexplode(F.transform(spans, content)).alias("chunk_index", "content")).filter("content <> ''")


def _tail(buf: Column, overlap: Column, last_only: Column | None = None, at_least_one: bool = False) -> Column:
    """How many trailing sentences of ``buf`` (their lengths) fit the overlap."""
    fit = F.aggregate(
        F.reverse(buf),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, n: F.when(
            a["open"] & (a["sum"] + n <= overlap),
            F.struct((a["sum"] + n).alias("sum"), (a["n"] + 1).alias("n"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["sum"].alias("sum"), a["n"].alias("n"), F.lit(False).alias("open"))),
        lambda a: a["n"],
    )
    if at_least_one:
        fit = F.when(overlap > 0, F.greatest(fit, F.least(F.lit(1), F.size(buf)))).otherwise(F.lit(0))
    if last_only is not None:
        fit = F.when(last_only, F.least(F.lit(1), F.size(buf))).otherwise(fit)
    return fit


def _last(buf: Column, n: Column) -> Column:
    """The last n items, also for n = 0."""
    return F.slice(buf, F.size(buf) - n + 1, n)


def _array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def chunk_sentence_overlap(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pack sentences to a size set by the document's length; whole trailing sentences carry over."""
    n_chars = F.length(F.col(text))
    size_limit, overlap = None, None
    for over, size, lap in R.SIZE_STEPS:
        size_limit = F.when(n_chars > over, size) if size_limit is None else size_limit.when(n_chars > over, size)
        overlap = F.when(n_chars > over, lap) if overlap is None else overlap.when(n_chars > over, lap)
    def state(at, size, buf, done):
        return F.struct(at.alias("at"), size.alias("size"), buf.alias("buf"), done.alias("done"))

    close = lambda a: _with(a["done"], a["at"] - F.size(a["buf"]), F.size(a["buf"]))
    zero = {"at": F.lit(1), "size": F.lit(0), "buf": F.array().cast("array<int>")}

    def step(cfg, a, n):
        carried = lambda kept: state(
            a["at"] + 1, _array_sum(kept) + F.size(kept) + n, F.concat(kept, F.array(n)), close(a))
        cut = let(_tail(a["buf"], cfg["lap"]), lambda k: let(_last(a["buf"], k), carried))
        grown = state(a["at"] + 1, a["size"] + n, F.concat(a["buf"], F.array(n)), a["done"])
        return F.when((F.size(a["buf"]) > 0) & (a["size"] + n > cfg["size"]), cut).otherwise(grown)

    # sizes are bound once per document; a bare column could be computed again for every sentence
    spans = let(F.struct(F.col("size_limit").alias("size"), F.col("overlap").alias("lap")), lambda cfg: fold_out(
        F.transform("sents", lambda s: F.length(s)), zero, SPAN, lambda a, n: step(cfg, a, n), close))
    # tested on the text: the size of the sentences would split it once more, below the shuffle of a dealt table
    packed = df.filter(F.col(text) != "").select(
        key, sentences(F.col(text)).alias("sents"), size_limit.alias("size_limit"), overlap.alias("overlap"))
    texts = F.transform(spans, lambda span: strip(_joined(span)))
    return packed.select(key, F.posexplode(texts).alias("chunk_index", "content")).filter("content <> ''")


# --- C5, C7, C8, C9: cues between sentences -----------------------------------------


def _starts(text: Column, heads: list[str], whole_word: bool) -> Column:
    if whole_word:
        return text.rlike(f"^(?:{'|'.join(heads)}){R.NOT_BEFORE_WORD}")
    return starts_with_any(text, heads)


def _holds(text: Column, needles: list[str], whole_word: bool) -> Column:
    """One pattern per list: sentences are short, and the text is computed once."""
    found = f"(?:{'|'.join(needles)})"
    return text.rlike(f"{R.NOT_AFTER_WORD}{found}{R.NOT_BEFORE_WORD}" if whole_word else found)


def break_flags(current: Column, following: Column, whole_word: bool = False) -> dict[str, Column]:
    """The cues for a break between two sentences, by name."""
    cur, nxt = strip(current), strip(following)
    low = F.lower(nxt)
    return {
        "paragraph": cur.contains("\n\n") | cur.endswith("\n"),
        "transition": _starts(low, R.TRANSITION_MARKERS, whole_word),
        "quote_end": cur.rlike("""["']\\z""") & ~nxt.startswith('"'),
        "time_marker": _holds(F.substring(low, 1, 50), R.TIME_MARKERS, whole_word),
        "speaker": nxt.rlike(f"(?:{R.SPEAKER_START})|(?:{R.SPEAKER_QUOTE})"),
    }


def is_break(current: Column, following: Column, whole_word: bool = False) -> Column:
    """Any cue; for use inside a fold, where nothing is shared between expressions unless bound."""

    def cues(cur, nxt, head):
        return (
            cur.contains("\n\n") | (cur.rlike("""["']\\z""") & ~nxt.startswith('"'))
            | _starts(head, R.TRANSITION_MARKERS, whole_word) | _holds(head, R.TIME_MARKERS, whole_word)
            | nxt.rlike(f"(?:{R.SPEAKER_START})|(?:{R.SPEAKER_QUOTE})")
        )

    return let(strip(current), lambda cur: let(strip(following), lambda nxt: let(
        F.lower(F.substring(nxt, 1, 50)), lambda head: cues(cur, nxt, head))))


def semantic_breakpoints(df: DataFrame, key: str, text: str, whole_word: bool = False) -> DataFrame:
    """Breaks between neighbouring sentences with the cues that made them.

    Neighbours are zipped inside the row's sentence array, so nothing is shuffled.
    """
    pairs = df.select(key, sentences(F.col(text)).alias("s")).select(
        key,
        F.posexplode(F.zip_with(
            F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))),
            F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))),
            lambda a, b: F.struct(a.alias("cur"), b.alias("nxt")),
        )).alias("i", "pair"),
    )
    flags = break_flags(F.col("pair.cur"), F.col("pair.nxt"), whole_word)
    out = pairs.select(key, (F.col("i") + 1).alias("sentence_index"), F.struct(*[c.alias(n) for n, c in flags.items()]).alias("f"))
    # one struct is tested and unpacked, so the cues are not computed again for the filter
    hit = F.filter(F.array("f"), lambda f: any_of([f[n] for n in flags]))
    return out.select(key, "sentence_index", F.explode(hit).alias("f")).select(key, "sentence_index", "f.*")


def has_contextual_connection(following: Column, whole_word: bool = False) -> Column:
    """The sentence opens with a pronoun or a continuing conjunction."""
    return _starts(F.lower(following), R.REFERENCE_STARTS + R.CONTINUATION_STARTS, whole_word)


def good_breakpoint(current: Column, following: Column, strict: bool = False, whole_word: bool = False) -> Column:
    """A good place to close a chunk.

    ``strict`` keeps the rule as first written, where the next sentence is
    lower-cased before its capital is looked for, so that rule never fires.
    """
    cur, nxt = strip(current), strip(following)
    opens = nxt == "" if strict else (nxt == "") | nxt.rlike(r"^\p{Lu}")
    return (
        (cur.endswith(".") & opens)
        | _holds(F.lower(cur), R.CONCLUSION_WORDS, whole_word)
        | _starts(F.lower(nxt), R.TOPIC_STARTS, whole_word)
    )


def semantic_overlap(sents: Column, overlap: Column) -> Column:
    """Trailing sentences that fit the overlap, one at least; none for an overlap of 0."""
    lens = F.transform(sents, lambda s: F.length(s))
    return _last(sents, _tail(lens, overlap, at_least_one=True))


def contextual_overlap(sents: Column, overlap: Column, following: Column) -> Column:
    """As ``semantic_overlap``, but only the last sentence where the next one refers back to it."""
    lens = F.transform(sents, lambda s: F.length(s))
    fit = F.greatest(_tail(lens, overlap), F.least(F.lit(1), F.size(sents)))
    n = F.when(has_contextual_connection(following), F.least(F.lit(1), F.size(sents))).otherwise(fit)
    return _last(sents, n)


# --- C6, C13: the semantic folds -------------------------------------------------------


def _semantic_spans(cfg: Column, contextual: bool, target_close: bool, strict: bool, whole_word: bool) -> Column:
    """Fold over ``sents`` to a struct (done spans, tail span); ``cfg`` has target, max, min, overlap."""
    n_sents = F.size("sents")
    following = F.concat(F.slice("sents", 2, F.greatest(n_sents - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    previous = F.concat(F.array(F.lit(None).cast("string")), F.slice("sents", 1, n_sents - 1))
    pair = F.arrays_zip("sents", previous.alias("prev"), following.alias("nxt"))
    items = F.transform(pair, lambda p: F.struct(
        F.length(p["sents"]).alias("n"),
        F.coalesce(is_break(p["prev"], p["sents"], whole_word), F.lit(False)).alias("brk"),
        (F.coalesce(good_breakpoint(p["sents"], p["nxt"], strict, whole_word), F.lit(False))
         if target_close else F.lit(False)).alias("good"),
        (has_contextual_connection(p["sents"], whole_word) if contextual else F.lit(False)).alias("conn"),
    ))
    def state(at, buf, done):
        return F.struct(at.alias("at"), buf.alias("buf"), done.alias("done"))

    empty = F.array().cast("array<int>")
    close = lambda a: _with(a["done"], a["at"] - F.size(a["buf"]), F.size(a["buf"]))
    chars = lambda buf: _array_sum(buf) + F.greatest(F.size(buf) - 1, F.lit(0))

    def restart(cfg, a, x):
        kept = (
            F.when(x["conn"], F.least(F.lit(1), F.size(a["buf"])))
            .otherwise(F.greatest(_tail(a["buf"], cfg["overlap"]), F.least(F.lit(1), F.size(a["buf"]))))
            if contextual else _tail(a["buf"], cfg["overlap"], at_least_one=True)
        )
        return state(a["at"], let(kept, lambda k: _last(a["buf"], k)), close(a))

    def add(cfg, a, x):
        grown = state(a["at"] + 1, F.concat(a["buf"], F.array(x["n"])), a["done"])
        if not target_close:
            return grown
        return let(grown, lambda g: F.when(
            x["good"] & (chars(g["buf"]) >= cfg["target"]), state(g["at"], empty, close(g))).otherwise(g))

    def step(cfg, a, x):
        def go(size):
            must = (size > 0) & ((x["brk"] & (size >= cfg["min"])) | (size + x["n"] > cfg["max"]))
            return let(F.when(must, restart(cfg, a, x)).otherwise(a), lambda b: add(cfg, b, x))

        return let(chars(a["buf"]), go)

    def finish(cfg, a):
        def go(size):
            own = (size > 0) & ((size >= cfg["min"]) | (F.size(a["done"]) == 0))
            return F.struct(
                F.when(own, close(a)).otherwise(a["done"]).alias("done"),
                F.when((size > 0) & ~own, F.struct((a["at"] - F.size(a["buf"])).alias("first"), F.size(a["buf"]).alias("n"))).alias("tail"),
            )

        return let(chars(a["buf"]), go)

    # sizes are bound once per row; a bare column could be computed again for every sentence
    return let(cfg, lambda c: fold_out(
        items, {"at": F.lit(1), "buf": empty}, SPAN, lambda a, x: step(c, a, x), lambda a: finish(c, a)))


def _semantic_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    """Explode the folded spans; a short last piece is appended to the chunk before it."""
    total = F.size("folded.done")
    rest = F.nullif(strip(_joined(F.col("folded.tail"))), F.lit(""))
    rows = df.select(*keep, rest.alias("tail"), total.alias("total_chunks"), F.posexplode(
        F.transform("folded.done", lambda span: strip(_joined(span)))).alias("chunk_index", "own"))
    tail = F.when(F.col("chunk_index") == F.col("total_chunks") - 1, F.col("tail"))
    return rows.select(*keep, "chunk_index", "total_chunks", F.concat_ws(" ", "own", tail).alias("content"))


def chunk_semantic(df: DataFrame, key: str, text: str, cfg: Column | None = None, strict: bool = False,
                   whole_word: bool = False) -> DataFrame:
    """Chunks that close at cues between sentences: key, chunk_index, total_chunks, content, heading."""
    cfg = cfg if cfg is not None else chunk_profile(F.col(text))
    base = df.select(key, sentences(F.col(text)).alias("sents"), cfg.alias("cfg")).filter(F.size("sents") > 0)
    folded = _semantic_spans(F.col("cfg"), contextual=False, target_close=True, strict=strict, whole_word=whole_word)
    rows = _semantic_rows(base.select(key, "sents", folded.alias("folded")), [key])
    first_line = F.filter(F.split("content", "\n"), lambda line: strip(line) != "")[0]
    return rows.withColumn(
        "heading", F.when((F.col("chunk_index") == 0) & (F.length(first_line) < R.MIN_CHARS), first_line)
    )


# --- C10 to C13: sections ------------------------------------------------------------------


def sections(df: DataFrame, key: str, text: str, structure: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text from each heading to the next: key, section_index, level, heading, section.

    ``structure`` is an array of (start, level, heading), sorted and zipped with its
    own shift inside the row. Arrays that bring their ``section`` are only unpacked.
    """
    rows = df.select(key, *keep, text, F.posexplode(F.col(structure)).alias("section_index", "h"))
    if "section" not in df.schema[structure].dataType.elementType.fieldNames():
        ordered = F.array_sort(F.transform(structure, lambda h: F.struct(
            h["start"].alias("start"), h["level"].alias("level"), h["heading"].alias("heading"))))
        ends = lambda hs: F.concat(F.transform(F.slice(hs, F.lit(2), F.size(hs)), lambda h: h["start"]), F.array(F.length(text)))
        cut = let(ordered, lambda hs: F.zip_with(hs, ends(hs), lambda h, stop: F.struct(
            h["start"].alias("start"), h["level"].alias("level"), h["heading"].alias("heading"),
            strip(_cut(F.col(text), h["start"], stop)).alias("section"))))
        rows = df.select(key, *keep, F.posexplode(cut).alias("section_index", "h"))
    return rows.select(key, *keep, "section_index", "h.level", "h.heading", "h.section").filter("section <> ''")


def section_importance(level: Column, heading: Column, section: Column) -> Column:
    """1, plus heading level, keyword and density bonuses; at most 2."""
    stops = F.regexp_count(section, F.lit("[.!?]+"))
    dense = let(F.struct(word_count(section).alias("w"), stops.alias("s")), lambda n: F.when(
        (n["w"] > 0) & (n["s"] / n["w"] * 100).between(3, 8), 0.2).otherwise(0.0))
    keyword = F.lower(F.coalesce(heading, F.lit(""))).rlike("|".join(R.SECTION_KEYWORDS))
    score = (
        F.lit(1.0)
        + F.when(F.coalesce(level, F.lit(0)) != 0, (7 - F.least(level, F.lit(6))) * 0.15).otherwise(0.0)
        + F.when(keyword, 0.3).otherwise(0.0)
        + dense
    )
    return F.least(score, F.lit(2.0))


def section_config(cfg: Column, importance: Column, n_chars: Column) -> Column:
    """Larger limits for important sections, a smaller target for very long ones."""

    def sized(m):
        c, grow, long = m["cfg"], m["importance"] > 1.5, m["n"] > m["cfg"]["max"] * 3
        return F.struct(
            F.when(grow, c["target"] * 1.3).when(long, c["target"] * 0.9).otherwise(c["target"]).cast("int").alias("target"),
            F.when(grow, c["max"] * 1.2).otherwise(c["max"]).cast("int").alias("max"),
            c["min"].alias("min"),
            F.when(grow, c["overlap"] * 1.5).otherwise(c["overlap"]).cast("int").alias("overlap"),
        )

    return let(F.struct(cfg.alias("cfg"), importance.alias("importance"), n_chars.alias("n")), sized)


def chunk_structured(df: DataFrame, key: str, text: str, structure: str, cfg: Column | None = None,
                     whole_word: bool = False) -> DataFrame:
    """Chunks per section: whole where it fits, else split with contextual overlap."""
    cfg = cfg if cfg is not None else chunk_profile(F.col(text))
    parts = sections(df.withColumn("base_cfg", cfg), key, text, structure, keep=("base_cfg",))
    parts = parts.withColumn("importance", section_importance(F.col("level"), F.col("heading"), F.col("section")))
    parts = parts.withColumn("cfg", section_config(F.col("base_cfg"), F.col("importance"), F.length("section")))
    keep = [key, "section_index", "level", "heading", "importance", "fits"]
    fits = F.length("section") <= F.col("cfg.max")
    cut = F.when(F.col("fits"), F.array("section")).otherwise(sentences(F.col("section")))
    parts = parts.withColumn("fits", fits).select(*keep, "cfg", cut.alias("sents"))
    whole = F.struct(
        F.array(F.struct(F.lit(1).alias("first"), F.lit(1).alias("n"))).alias("done"),
        F.lit(None).cast("struct<first:int,n:int>").alias("tail"))
    split = _semantic_spans(F.col("cfg"), contextual=True, target_close=False, strict=False, whole_word=whole_word)
    rows = _semantic_rows(parts.select(*keep, "sents", F.when(F.col("fits"), whole).otherwise(split).alias("folded")), keep)
    fading = F.greatest(F.col("importance") * (1.0 - F.col("chunk_index") * 0.1), F.lit(0.5))
    return rows.withColumns({
        "chunk_type": F.when(F.col("fits"), "section").otherwise("section_chunk"),
        "importance": F.when(F.col("fits"), F.col("importance")).otherwise(fading),
    }).drop("fits")


# --- C14: character splitter -----------------------------------------------------------------


def chunk_chars(df: DataFrame, key: str, text: str, cfg: Column | None = None) -> DataFrame:
    """Cut at the last ., ! or ? once the target is reached; force a cut at the maximum.

    The fold walks from one stop character to the next, not over characters. No
    text is dropped; a short rest is appended to the last chunk.
    """
    cfg = cfg if cfg is not None else chunk_profile(F.col(text))
    clauses = F.split(text, "(?<=[.!?])")
    zero = {"at": F.lit(0), "start": F.lit(0), "mark": F.lit(-1)}
    bound = let(F.col("cfg"), lambda c: _char_fold(c["target"], c["max"], c["min"], c["overlap"], zero))
    base = df.select(key, text, cfg.alias("cfg")).select(key, F.col(text).alias("joined"), "cfg", clauses.alias("clauses"))
    folded = base.select(key, "joined", bound.alias("folded"))
    total = F.size("folded.done")
    rows = folded.select(key, "joined", "folded.tail", total.alias("total_chunks"),
                         F.posexplode("folded.done").alias("chunk_index", "span"))
    body = _cut(F.col("joined"), F.col("span.start"), F.col("span.stop"))
    tail = _cut(F.col("joined"), F.col("tail.start"), F.col("tail.stop"))
    content = F.when(
        (F.col("chunk_index") == F.col("total_chunks") - 1) & F.col("tail").isNotNull(), F.concat(body, tail)
    ).otherwise(body)
    return rows.select(key, "chunk_index", content.alias("content"))


def _char_fold(target: Column, most: Column, least: Column, lap: Column, zero: dict[str, Column]) -> Column:
    """Fold over ``clauses`` to a struct (cuts, short rest)."""

    def add(done, start, stop):
        return F.concat(done, F.array(F.struct(start.alias("start"), stop.alias("stop"))))

    def state(at, start, mark, done):
        return F.struct(at.alias("at"), start.alias("start"), mark.alias("mark"), done.alias("done"))

    none = F.lit(-1)

    def forced(a, now):
        """After a cut: the rest may itself have reached the maximum."""
        return F.when(
            now - a["start"] >= most, state(a["at"], now, none, add(a["done"], a["start"], now))
        ).otherwise(a)

    def cut_at_mark(a, mark, now):
        cut = state(a["at"], F.greatest(a["start"], mark - lap), none, add(a["done"], a["start"], mark))
        return let(cut, lambda c: forced(c, now))

    def between(a, limit):
        """Everything that happens strictly before position ``limit``."""
        due, hard = a["start"] + target, a["start"] + most
        marked = F.when(
            (a["mark"] >= 0) & (due <= hard) & (due < limit), cut_at_mark(a, a["mark"], due)
        ).when(
            (a["mark"] >= 0) & (hard < due) & (hard < limit), state(a["at"], hard, none, add(a["done"], a["start"], hard))
        ).otherwise(a)

        def run(b):
            n = F.when(b["mark"] < 0, F.floor((limit - 1 - b["start"]) / most).cast("int")).otherwise(F.lit(0))
            more = F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.struct((b["start"] + (i - 1) * most).alias("start"), (b["start"] + i * most).alias("stop")),
            )
            return F.when(n > 0, state(b["at"], b["start"] + n * most, none, F.concat(b["done"], more))).otherwise(b)

        return let(marked, run)

    def on_stop(a, now):
        """A stop character ends at ``now``."""
        size = now - a["start"]
        return (
            F.when(size >= target, cut_at_mark(a, now, now))
            .when(size >= most, state(a["at"], now, none, add(a["done"], a["start"], now)))
            .otherwise(state(a["at"], a["start"], now, a["done"]))
        )

    def step(a, clause):
        def go(now):
            ends = clause.rlike(r"[.!?]\z")
            moved = let(between(a, F.when(ends, now).otherwise(now + 1)), lambda b: F.when(ends, on_stop(b, now)).otherwise(b))
            return let(moved, lambda b: state(now, b["start"], b["mark"], b["done"]))

        return let(a["at"] + F.length(clause), go)

    def finish(a):
        rest = a["at"] - a["start"]
        own = (rest > 0) & ((rest >= least) | (F.size(a["done"]) == 0))
        return F.struct(
            F.when(own, add(a["done"], a["start"], a["at"])).otherwise(a["done"]).alias("done"),
            F.when((rest > 0) & ~own, F.struct(a["start"].alias("start"), a["at"].alias("stop"))).alias("tail"),
        )

    return fold_out("clauses", zero, ("start", "stop"), step, finish)


# --- C15, C16 -------------------------------------------------------------------------------------


def route_chunker(df: DataFrame, key: str, text: str, structure: str) -> DataFrame:
    """Structured chunks where headings are known, else semantic chunks, in one table."""
    cols = [key, "section_index", "chunk_index", "chunk_type", "heading", "importance", "content"]
    has = F.coalesce(F.size(structure) > 0, F.lit(False))
    by_section = chunk_structured(df.filter(has), key, text, structure).select(*cols)
    plain = chunk_semantic(df.filter(~has), key, text).select(
        key, F.lit(0).alias("section_index"), "chunk_index", F.lit("text_chunk").alias("chunk_type"), "heading",
        F.lit(1.0).alias("importance"), "content",
    )
    return by_section.unionByName(plain)


def chunk_neighbours(chunks: DataFrame, key: str) -> DataFrame:
    """Previous and next chunk in brief, and the position within the document."""
    order = W.partitionBy(key).orderBy("chunk_index")
    brief = F.struct("heading", "chunk_type", F.substring("context_summary", 1, 50).alias("summary"))
    total = F.count(F.lit(1)).over(W.partitionBy(key))
    return (
        chunks.withColumn("prev_context", F.lag(brief).over(order))
        .withColumn("next_context", F.lead(brief).over(order))
        .withColumn("chunk_position", F.row_number().over(order))
        .withColumn("total_chunks", total)
        .withColumn("relative_position", F.col("chunk_position") / F.col("total_chunks"))
    )
