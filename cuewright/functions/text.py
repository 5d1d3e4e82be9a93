"""Column expressions over text; every one stays inside the JVM."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K


def long(col) -> Column:
    return col.cast("bigint")


def rec(**fields) -> Column:
    """A struct with exactly these field names."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col) -> Column:
    """Trim the full Unicode white-space set from both ends."""
    return F.btrim(col, F.lit(K.WHITESPACE))


def words(col) -> Column:
    """Split on runs of white space, no empty words."""
    return F.filter(F.split(col, f"[{K.WHITESPACE_CLASS}]+"), lambda w: w != "")


def split_lines(col) -> Column:
    return F.split(col, K.LINE_BREAK)


def has_cjk(col) -> Column:
    return col.rlike(f"[{K.CJK_CLASS}]")


def cjk_count(col, klass: str = K.CJK_CLASS) -> Column:
    return F.regexp_count(col, F.lit(f"[{klass}]"))


def last_char(col) -> Column:
    return F.right(col, F.lit(1))


def first_char(col) -> Column:
    return F.substring(col, 1, 1)


def half_up(col) -> Column:
    """Round a non-negative double to the nearest integer, halves upward."""
    return F.floor(col + F.lit(0.5)).cast("bigint")


# ---- clocks -------------------------------------------------------------------
def _pad(col, width: int) -> Column:
    return F.lpad(col.cast("string"), width, "0")


def cue_clock(ms, separator: str = ",") -> Column:
    """HH:MM:SS,mmm over whole milliseconds, so no unit can reach 1000 or 60."""
    t = F.greatest(long(ms), F.lit(0).cast("bigint"))
    hours = t.cast("bigint") / F.lit(3_600_000)
    hours = F.floor(hours)
    return F.concat(
        F.when(hours < 100, _pad(hours, 2)).otherwise(hours.cast("string")), F.lit(":"),
        _pad(F.floor(t % 3_600_000 / 60_000), 2), F.lit(":"),
        _pad(F.floor(t % 60_000 / 1000), 2), F.lit(separator), _pad(t % 1000, 3))


_EDGE = "\x1f"  # white space to words(), so that no piece has it
# A word may also be parted after a hyphen between letters, and on both sides of a dash of several hyphens.
_LETTER, _BEFORE_DASH = r"[^\d\W]", r"[\w!\"'&.,?]"
_AFTER_HYPHEN = rf"(?U)(?:(?<={_LETTER}{{2}}-)|(?<={_LETTER}-{_LETTER}-))(?={_LETTER}-?{_LETTER})" \
                rf"|(?<={_BEFORE_DASH})(?=-{{2,80}}\w)|(?<={_BEFORE_DASH}-{{2,80}})(?=\w)"


def _chunks(col) -> Column:
    """Unbreakable pieces with the glue that precedes each: a space, or nothing."""
    return F.flatten(F.transform(words(col), lambda w: F.transform(
        F.split(w, _AFTER_HYPHEN), lambda p, i: rec(g=F.when(i == 0, " ").otherwise(""), w=p))))


def _cut_at(word: Column, room: Column) -> Column:
    """Characters of a long word that go on a line with ``room``: up to its last hyphen there, if a letter precedes one."""
    hyphen = F.length(F.regexp_extract(F.substr(word, F.lit(1), room), r"^[\s\S]*[^-][\s\S]*-", 0))
    return F.when(hyphen > 0, hyphen).otherwise(room)


def _pieces(word: Column, width: int) -> Column:
    """A long word line by line; only the last piece may be shorter for want of more."""
    def step(acc, _):
        size = _cut_at(acc["rest"], F.lit(width))
        return F.when(F.length(acc["rest"]) <= width, acc).otherwise(
            rec(out=F.concat(acc["out"], F.array(F.substr(acc["rest"], F.lit(1), size))), rest=F.substr(acc["rest"], size + 1)))
    none = F.array().cast("array<string>")  # a piece has two characters at least
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(word) / 2).cast("int")), rec(out=none, rest=word), step,
                       lambda acc: F.when(acc["rest"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["rest"]))))


def wrap_cue(col, width: int = 42, lines: int = 2) -> Column:
    """Greedy word wrap to ``width``; text past the last line ends in an ellipsis.

    One fold over the pieces keeps the finished lines and the open one; a piece
    longer than a line is cut at its last hyphen that fits, else at the line edge.
    """
    flat = F.array_join(words(col), " ")
    none = F.array().cast("array<string>")
    # cur is the open line, marked the same with _EDGE between its pieces, done holds marked lines

    def step(acc, c):
        cur, word = acc["cur"], c["w"]
        glue = F.when(cur == "", "").otherwise(c["g"])
        edge = F.when(cur == "", "").otherwise(_EDGE)
        spaced = F.concat(cur, glue, word)
        room = F.lit(width) - F.length(cur) - F.length(glue)
        size = _cut_at(word, room)
        # a space that just fits stays at the end of the line
        head = F.when(room >= 1, F.concat(acc["marked"], edge, glue, F.substr(word, F.lit(1), size))) \
            .when((room == 0) & (glue == " "), F.concat(acc["marked"], edge, glue)).otherwise(acc["marked"])
        rest = F.when(room >= 1, F.substr(word, size + 1)).otherwise(word)
        filled = F.concat(acc["done"], F.array(head), _pieces(rest, width))
        return F.when(F.length(spaced) <= width, rec(done=acc["done"], cur=spaced, marked=F.concat(acc["marked"], edge, glue, word))) \
            .when(F.length(word) > width, rec(done=F.slice(filled, F.lit(1), F.size(filled) - 1), cur=F.element_at(filled, -1), marked=F.element_at(filled, -1))) \
            .otherwise(rec(done=F.concat(acc["done"], F.array(acc["marked"])), cur=word, marked=word))

    folded = F.aggregate(_chunks(col), rec(done=none, cur=F.lit(""), marked=F.lit("")), step,
                         lambda acc: F.concat(acc["done"], F.array(acc["marked"])))

    def shown(marked):
        all_lines = F.transform(marked, lambda t: F.replace(t, F.lit(_EDGE), F.lit("")))
        above = F.slice(all_lines, 1, lines - 1)
        over = F.rtrim(F.element_at(above, -1))

        def ending(parts):
            # The last kept line gives up pieces until the ellipsis fits; if it has
            # none left, the line above carries the ellipsis.
            prefixes = F.filter(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(
                F.slice(parts, F.lit(1), F.size(parts) - k), "")), lambda t: F.length(t) < width)
            return let(prefixes, lambda p: F.when(F.size(p) > 0, F.concat(above, F.array(F.concat(F.get(p, F.lit(0)), F.lit("…")))))
                       .when(F.length(over) < width, F.concat(F.slice(above, F.lit(1), F.size(above) - 1), F.array(F.concat(over, F.lit("…")))))
                       .otherwise(F.concat(above, F.array(F.lit("…")))))

        cut = let(F.split(F.element_at(F.slice(marked, 1, lines), -1), _EDGE), ending)
        return F.array_join(F.when(F.size(all_lines) <= lines, all_lines).otherwise(cut), "\n")

    return F.when(F.length(flat) <= width, flat).otherwise(let(folded, shown))


# ---- budgets ------------------------------------------------------------------
def budget_chars(start_ms, end_ms) -> Column:
    """Characters of English that fit the slot at fifteen per second."""
    span = F.greatest(F.lit(K.MIN_SPAN_MS).cast("bigint"), end_ms - start_ms)
    return F.greatest(F.lit(K.MIN_BUDGET_CHARS).cast("bigint"),
                      F.floor(span * K.CHARS_PER_SECOND / 1000).cast("bigint"))


def estimate_tokens(col) -> Column:
    cjk = cjk_count(col)
    return long(cjk + F.floor((F.length(col) - cjk) / 3) + 8)


# ---- audit --------------------------------------------------------------------
_NOT_WORD = r"[^\p{L}\p{N}_]"


def _says(text, phrases: str, *stems: str) -> Column:
    """Whether one of ``phrases`` stands there as words of its own; the pattern is tried only where a stem of them all is."""
    low = F.lower(text)
    seen = F.contains(low, F.lit(stems[0]))
    for stem in stems[1:]:
        seen = seen | F.contains(low, F.lit(stem))
    return seen & text.rlike(f"(?i)(^|{_NOT_WORD})({phrases})($|{_NOT_WORD})")


def clash(en) -> Column:
    return _says(en, K.CLASH_PHRASES, "his husband", "his wives", "her wife")


def second_person(text) -> Column:
    return _says(text, K.SECOND_PERSON_WORDS, "you")


def dangling(en) -> Column:
    """Ends in an ellipsis or in a word that asks for more, one point or comma after it or not.

    Only the end is looked at: the longest such word and one character before it.
    """
    space, longest = F.lit(K.WHITESPACE), max(len(w) for w in K.DANGLING_WORDS.split("|"))
    end = F.rtrim(en, space)
    bare = F.rtrim(F.when(F.right(end, F.lit(1)).isin(".", ","), F.substr(end, F.lit(1), F.length(end) - 1)).otherwise(end), space)
    return end.endswith("...") | end.endswith("…") | F.right(bare, F.lit(longest + 1)).rlike(rf"(?i)(^|{_NOT_WORD})({K.DANGLING_WORDS})$")


def quote_marks(en) -> Column:
    return F.regexp_count(en, F.lit(f"[{K.QUOTES}]"))


def narration_of(en, inside) -> Column:
    """Text outside quotation marks, given whether a quotation is already open."""
    pieces = F.split(en, f"[{K.QUOTES}]", -1)
    skip = F.when(inside, 1).otherwise(0)
    return F.array_join(F.filter(pieces, lambda p, i: i % 2 == skip), " ")


def source_left(en) -> Column:
    return en.rlike(f"[{K.SOURCE_SCRIPT_CLASS}]")


def over_budget(en, budget) -> Column:
    return F.length(en) > budget * F.lit(K.OVER_BUDGET)


def dropped_content(en, source, budget) -> Column:
    n = F.length(en)

    def short(of):
        mostly_cjk = of["cjk"] >= of["chars"] * F.lit(0.5)
        size = F.when(mostly_cjk, of["cjk"]).otherwise(of["chars"])
        floor = F.when(mostly_cjk, F.lit(K.EXPANSION_CJK)).otherwise(F.lit(K.EXPANSION_LATIN))
        return (of["chars"] > 0) & (size >= K.MIN_SOURCE_CHARS) & (n < size * floor)

    # the cheap test first: most lines fill their budget
    return (n > 0) & (n < budget * F.lit(K.UNDERFILL)) & let(rec(cjk=cjk_count(source, K.SOURCE_SCRIPT_CLASS), chars=F.length(source)), short)


# ---- speech -------------------------------------------------------------------
def _fold_table() -> tuple[str, str]:
    """Base letter for every accented letter, by rule from the Unicode tables.

    A character folds when dropping its combining marks below U+0370 leaves one
    other character; the marks themselves fold to nothing.
    """
    table = {"đ": "d", "Đ": "D"}
    for code in range(0xA0, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        kept = "".join(c for c in unicodedata.normalize("NFD", ch)
                       if not (unicodedata.combining(c) and 0x80 <= ord(c) < 0x370))
        folded = unicodedata.normalize("NFC", kept)
        if folded != ch and len(folded) <= 1:
            table.setdefault(ch, folded)
    gone = [c for c, f in table.items() if f == ""]
    letters = [c for c, f in table.items() if f]
    return "".join(letters + gone), "".join(table[c] for c in letters)


FOLD_FROM, FOLD_TO = _fold_table()


def clean_for_speech(col) -> Column:
    """The line as a voice should receive it; the subtitle keeps its spelling."""
    space = K.WHITESPACE_CLASS
    plain = F.octet_length(col) == F.length(col)  # ASCII alone: nothing to fold
    t = F.regexp_replace(col, f"[{K.SPOKEN_CJK_CLASS}]+", " ")
    t = F.translate(t, "‑‒–‘’“”…­", "---''\"\" ")
    t = F.when(plain, col).otherwise(F.replace(t, F.lit("—"), F.lit(" - ")))
    t = F.regexp_replace(t, rf"^[{space}]*\.\.\.[{space}]*", "")
    t = F.when(plain, t).otherwise(F.translate(t, FOLD_FROM, FOLD_TO))
    return strip(F.regexp_replace(t, f"[{space}]{{2,}}|[{space}&&[^ ]]", " "))  # a single space is not written anew


def digest(*cols) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by a bar; NULL is blank."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


# ---- replies ------------------------------------------------------------------
def strip_think(col) -> Column:
    return strip(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""))


def parse_seconds(col) -> Column:
    """'1m26.4s', '30.097s', '2m' to seconds; anything else is 0."""
    pattern = r"^(?:(\d+)m)?([\d.]+)?s?"
    t = F.coalesce(strip(col), F.lit(""))
    minutes = F.coalesce(F.regexp_extract(t, pattern, 1).try_cast("double"), F.lit(0.0))
    seconds = F.coalesce(F.regexp_extract(t, pattern, 2).try_cast("double"), F.lit(0.0))
    return minutes * 60 + seconds


def reset_hint(message) -> Column:
    when = F.rtrim(F.regexp_extract(message, r"try again in ([\dhms.]+)", 1))
    when = F.rtrim(F.regexp_replace(when, r"\.+$", ""))
    return F.when(message.rlike(r"try again in [\dhms.]+"), F.concat(F.lit("resets in "), when)) \
        .otherwise(F.lit("resets later today"))


# ---- labels -------------------------------------------------------------------
def hhmmss(seconds) -> Column:
    t = F.greatest(F.lit(0).cast("bigint"), half_up(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))))
    h, m, s = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _pad(m, 2), F.lit(":"), _pad(s, 2))) \
        .otherwise(F.concat(m.cast("string"), F.lit(":"), _pad(s, 2)))


def minute_clock(seconds) -> Column:
    t = F.floor(F.greatest(F.lit(0.0), seconds)).cast("bigint")
    return F.concat(F.floor(t / 60).cast("string"), F.lit(":"), _pad(t % 60, 2))


def ago(seconds) -> Column:
    """Age in the largest whole unit, from a number of elapsed seconds."""
    out = F.lit("just now")
    for size, name in ((60, "minute"), (3600, "hour"), (86400, "day"),
                       (2592000, "month"), (31536000, "year")):
        n = F.floor(seconds / size).cast("bigint")
        out = F.when(seconds >= size, F.concat(
            n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))).otherwise(out)
    return out
