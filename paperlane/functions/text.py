"""Row-wise text functions as SQL fragments and Column builders; all stay inside the JVM.

Fragments take and give SQL text, so they can stand inside higher-order lambdas, where SQL functions of
one's own can't be called. Those marked portable mean the same in any SQL dialect with these functions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no meaning for a search.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can cannot could couldn't did didn't do does doesn't doing don't down
during each few for from further had hadn't has hasn't have haven't having he her here hers herself
him himself his how i if in into is isn't it its itself let's me more most mustn't my myself no nor
not of off on once only or other ought our ours ourselves out over own same shan't she should
shouldn't so some such than that the their theirs them themselves then there these they this those
through to too under until up very was wasn't we were weren't what when where which while who whom
why with won't would wouldn't you your yours yourself yourselves
please tell me show give find does do did done get got
""".split()

# Words that say nothing as a document's keyword.
NOISE = """
must may shall might will would can could should also however therefore hereby therein
said such using used one two three four five six seven eight nine ten first second third
new get got make made many much more most other others same each both every either neither
per via etc eg ie
""".split()


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


def _doubled(w: str, end: int) -> str:
    """1 if a word without its last end characters ends in a doubled letter that is made single, and keeps three characters; else 0."""
    last = f"substring({w}, {-1 - end}, 1)"
    return f"CASE WHEN length({w}) > {end + 3} AND {last} = substring({w}, {-2 - end}, 1) AND {last} NOT IN ('l', 's', 'z') THEN 1 ELSE 0 END"


# Word endings and what takes their place; after None a doubled last letter is made single.
ENDINGS = (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("ing", None), ("ed", None), ("ly", ""), ("s", ""))


#: A word and its stem begin with the same characters, so many of them; a shorter word is its own stem.
STEM_KEEPS = 3


def stem_sql(w: str) -> str:
    """The word with one English ending folded; the first rule that leaves three characters wins.

    How many characters go is told first, so that the code for it is small: the JVM never compiles a method of over 8,000 bytes.
    """
    # nothing else can end in one of the endings; digits can't either
    cut = f"CASE WHEN length({w}) <= 3 OR right({w}, 1) NOT IN ('s', 'g', 'd', 'y') THEN 0"
    added = "''"
    for ending, put in ENDINGS:
        fits = f"endswith({w}, '{ending}') AND length({w}) >= {len(ending) + 3}"
        if put is None:
            cut += f" WHEN {fits} THEN {len(ending)} + {_doubled(w, len(ending))}"
        elif ending.startswith(put):
            cut += f" WHEN {fits} THEN {len(ending) - len(put)}"
        else:  # the first rule: what takes the ending's place is no part of it
            cut, added = cut + f" WHEN {fits} THEN {len(ending)}", f"CASE WHEN {fits} THEN '{put}' ELSE '' END"
    return f"concat(left({w}, length({w}) - {cut} ELSE 0 END), {added})"


# Fixed value: what a word is.
TOKEN = r"[a-z0-9]++(?:['’\-]++[a-z0-9]++)*+"


def raw_tokens(text: str) -> Column:
    """array<string>: the words of a text, lower-cased, without outer quotes and hyphens."""
    pattern = TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"regexp_extract_all(lower({text}), '{pattern}', 0)")


def kept_sql(w: str, stopwords: bool = False) -> str:
    """Whether a raw token is searched for: no stop word (unless wanted), no single letter (portable)."""
    one = f"(length({w}) > 1 OR translate({w}, '0123456789', '') = '')"
    return f"{w} <> '' AND {one}" + ("" if stopwords else f" AND {w} NOT IN ({quoted(STOPWORDS)})")


def tokens(text: str, stopwords: bool = False) -> Column:
    """array<string>: the stemmed tokens of a text, in order."""
    return F.transform(F.filter(raw_tokens(text), lambda x: _kept(x, stopwords)), _stem)


def _kept(x: Column, stopwords: bool) -> Column:
    """kept_sql() for a lambda's variable."""
    digits = F.translate(x, "0123456789", "") == ""
    out = (x != "") & ((F.length(x) > 1) | digits)
    return out if stopwords else out & ~x.isin(*dict.fromkeys(STOPWORDS))


def _stem(x: Column) -> Column:
    """stem_sql() for a lambda's variable."""

    def undoubled(s: Column) -> Column:
        twice = F.right(s, F.lit(1)) == F.left(F.right(s, F.lit(2)), F.lit(1))
        return F.when((F.length(s) > 3) & twice & ~F.right(s, F.lit(1)).isin("l", "s", "z"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)

    out = F.when(F.length(x) <= 3, x)
    for ending, put in ENDINGS:
        rest = F.substring(x, F.lit(1), F.length(x) - len(ending))
        out = out.when(x.endswith(ending) & (F.length(x) >= len(ending) + 3), undoubled(rest) if put is None else F.concat(rest, F.lit(put)))
    return out.otherwise(x)


def term_of(w: str) -> str | None:
    """The stem of a raw token, as stem_sql() has it; None for one that kept_sql() leaves out. For tasks that tell words apart first, and ask for each once."""
    if not w or (len(w) == 1 and not "0" <= w <= "9") or w in _STOP:
        return None
    for ending, put in ENDINGS if len(w) > 3 else ():
        if w.endswith(ending) and len(w) >= len(ending) + 3:
            rest = w[: -len(ending)]
            if put is None:
                return rest[:-1] if len(rest) > 3 and rest[-1] == rest[-2] and rest[-1] not in "lsz" else rest
            return rest + put
    return w


_STOP = frozenset(STOPWORDS)


def words(text: str) -> Column:
    """array<string>: the words between white space."""
    return F.expr(rf"regexp_extract_all({text}, '\\S+', 0)")


def tidy(text: Column) -> Column:
    """Line ends to LF, control characters out, no-break spaces to spaces, blanks squeezed, at most one blank line."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f\x7f\ufeff]", "")
    out = F.regexp_replace(F.translate(out, "\u00a0", " "), r"[ \t]{2,}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def section_label(number: Column, heading: Column) -> Column:
    short = F.when(F.length(heading) > 48, F.concat(F.rtrim(F.substring(heading, 1, 45)), F.lit("…"))).otherwise(heading)
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("section “"), short, F.lit("”"))).otherwise(F.concat(F.lit("section "), number.cast("string")))


def safe_name(name: Column) -> Column:
    """A file name without separators, control characters and dot runs; at most 180 characters."""
    out = F.regexp_replace(name, r"[\\/\x00-\x1f]", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"^[\s.]+|[\s.]+$", "")
    return F.substring(F.when(out == "", F.lit("document")).otherwise(out), 1, 180)


def column_index(reference: Column) -> Column:
    """0 for A1, 26 for AA7."""
    letters = F.split(F.regexp_extract(F.upper(reference), "[A-Z]+", 0), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


# How an answer cites a place, and how it says that there is none.
CITATION = r"(?i)\((?:page|part|section|sheet)\s+[^)]{1,60}\)"
REFUSAL = r"(?i)could not find that in your document"


def highlight(text: Column, terms: list[str]) -> Column:
    """The text with <mark> around every word that begins with one of the terms of over two characters."""
    import re

    kept = [re.escape(t) for t in terms if len(t) > 2]
    return F.regexp_replace(text, rf"(?i)(?<![0-9A-Za-z_])(?:{'|'.join(kept)})\w*", r"<mark>$0</mark>") if kept else text


def score_bar(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(6), F.round(score / 8 * 100)))


def _typed(body: Column, path: str, kind: str) -> Column:
    """What body, parsed JSON, has at path, if it is of that kind; else null."""
    found = F.try_variant_get(body, path, "variant")
    return F.when(F.startswith(F.schema_of_variant(found), F.lit(kind)), found)


def _string(body: Column, path: str) -> Column:
    return F.try_variant_get(_typed(body, path, "STRING"), "$", "string")


def event_text(body: Column) -> Column:
    """The text in one event of a language model's stream, whichever protocol it speaks; of a body that isn't a JSON object, none.

    The body is parsed once; what a value is is asked of the value, not of its text. A message that is an object counts even if it is
    empty, so does a response that is a string; of the first choice, the first text that isn't empty counts.
    """
    v = F.try_parse_json(body)
    first = [F.nullif(_string(v, f"$.choices[0].{x}"), F.lit("")) for x in ("delta.content", "text", "message.content")]
    out = F.when(_typed(v, "$.message", "OBJECT").isNotNull(), F.coalesce(_string(v, "$.message.content"), F.lit(""))).otherwise(F.coalesce(_string(v, "$.response"), *first, F.lit("")))
    return F.when(_typed(v, "$", "OBJECT").isNotNull(), out).otherwise("")


# What comes before the text in a broken line, and what the letter after a backslash stands for.
SALVAGED = r'(?U)"(?:content|response|text)"\s*:\s*"'
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def salvaged_text(body: Column) -> Column:
    """The first content, response or text string of a broken JSON line, up to its closing quote or the line's end.

    One pass from left to right over escapes, plain stretches and quotes: a backslash takes the one character after it.
    """
    rest = F.regexp_replace(body, rf"(?s)^.*?{SALVAGED}", "")
    parts = F.regexp_extract_all(F.when(body.rlike(SALVAGED), rest).otherwise(""), F.lit(r'(?s)\\.|[^"\\]+|["\\]'), F.lit(0))
    end = F.array_position(parts, F.lit('"')).cast("int")
    said = F.slice(parts, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(parts)))

    def plain(x: Column) -> Column:
        after = F.substr(x, F.lit(2))
        out = after
        for letter, char in ESCAPES.items():
            out = F.when(after == letter, char).otherwise(out)
        return F.when(F.startswith(x, F.lit("\\")) & (after != ""), out).otherwise(x)

    return F.array_join(F.transform(said, plain), "")


def salvaged_error(body: Column) -> Column:
    """What went wrong, from a service's error body: its error's message, its error text, or the body itself; 200 characters.

    A message that is no string is as it would be printed: None, True, a number; a list or an object as JSON.
    """
    v = F.try_parse_json(body)
    message = F.try_variant_get(v, "$.error.message", "variant")
    kind = F.schema_of_variant(message)
    printed = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.to_json(message))).when(kind == "STRING", F.try_variant_get(message, "$", "string")).otherwise(F.to_json(message))
    inner = F.when(_typed(v, "$.error", "OBJECT").isNotNull(), F.coalesce(printed, F.lit("")))
    return F.substring(F.coalesce(inner, _string(v, "$.error"), F.regexp_replace(body, r"(?U)^\s+|\s+$", "")), 1, 200)


def port_of(url: Column) -> Column:
    """The port that a URL names, else that of its scheme."""
    named = F.regexp_extract(url, r":(\d{2,5})", 1)
    return F.when(named != "", named.cast("int")).when(url.startswith("https"), 443).otherwise(80)


# The icon of a kind of document, by the first word that it contains.
ICONS = (("pdf", "📕"), ("word", "📘"), ("spreadsheet", "📗"), ("web", "🌐"))


def kind_icon(kind: Column) -> Column:
    out = F.lit("📄")
    for word, icon in reversed(ICONS):
        out = F.when(F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit(word)), icon).otherwise(out)
    return out
