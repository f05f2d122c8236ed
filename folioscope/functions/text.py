"""Text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words (Italian and English) that tokens leave out.
STOP_WORDS = (
    "a about above after again against agli ai al alla alle allo an and at before below between but by che con da dagli dai dal dalla dalle dallo degli dei del della delle dello di "
    "down during e else for fra from further gli i if il in into is la le lo negli nei nel nella nelle nello non o off on once or out over per se su sugli sui sul sulla sulle sullo "
    "the then through to tra un una under uno up when with"
).split()


# The Italian stop words of the overlap and diversity checks.
WORD_STOPS = (
    "il lo la i gli le un uno una del dello della dei degli delle al allo alla ai agli alle dal dallo dalla dai dagli dalle nel nello nella nei negli nelle col coi sul sullo "
    "sulla sui sugli sulle di a da in con su per tra fra e ed o od ma se che chi cui non piu meno come dove quando quale quali quanto quanti quanta quante questo questa questi "
    "queste quello quella quelli quelle suo sua suoi sue loro nostro nostra nostri nostre vostro vostra vostri vostre mio mia miei mie tuo tua tuoi tue anche gia cosi solo "
    "tutto tutti tutta tutte molto molti molta molte poco pochi poca poche essere stato stati stata state sono sei era erano sara sarebbe sia siano fare fatto fatta fatti "
    "fatte fa fanno faceva avere ho hai ha abbiamo avete hanno aveva avevano ad ci vi ne si mi ti li ogni alcuni alcune alcuno alcuna senza dopo prima sopra sotto dentro fuori "
    "verso contro mediante durante"
).split()

# The folders of a vault.
FOLDERS = (
    "00_SYSTEM 01_CLIENTS 02_PROJECTS 03_BRANDS 04_POSITIONING 05_PACKAGING_KNOWLEDGE 06_METHODS 07_CASE_STUDIES 08_MARKET_RESEARCH 09_COMPETITORS 10_APPROVED_OUTPUTS 20_RAW_SOURCES "
    "80_AI_OUTPUTS 90_PROPOSALS 99_ARCHIVE"
).split()


def accent_map() -> tuple[str, str]:
    """The Latin letters that lose marks of U+0300 to U+036F under NFD, and what is left of each."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            marked.append(chr(code))
            plain.append(bare)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = accent_map()


def fold(text: Column) -> Column:
    """Without accents, then lower case; bare combining marks go too."""
    return F.lower(F.regexp_replace(F.translate(text, MARKED, PLAIN), "[\\u0300-\\u036F]", ""))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def strip_markdown(text: Column) -> Column:
    """Front matter and code fences out, links as their text, heading and quote marks and emphasis out, spaces collapsed."""
    for pattern, put in (
        ("(?s)^---\\n.*?\\n---(\\n|$)", ""), ("(?s)```.*?```", " "), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("(?m)^#{1,6}[ \\t]+", ""), ("(?m)^>[ \\t]*", ""), ("[`*_]", ""),
    ):
        text = F.regexp_replace(text, pattern, put)
    return collapse(text)


def has_markup(text: Column) -> Column:
    """Whether stripping Markdown may change a text's words; marks of headings and quotes stand between words anyway."""
    return F.rlike(text, F.lit("[`*_\\[]|^---\\n"))


def tokens(text: Column) -> Column:
    """Folded words of at least two characters that are no stop words, in order, repeats kept."""
    words = F.split(fold(F.when(has_markup(text), strip_markdown(text)).otherwise(text)), "[^\\p{L}\\p{N}]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(STOP_WORDS))


def contains_whole_words(text: Column, needle: Column) -> Column:
    """Whether needle stands in text with no letter or digit next to it; a blank needle never does."""
    bounded = F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), F.replace(F.trim(needle), F.lit("\\E"), F.lit("")), F.lit("\\E(?![\\p{L}\\p{N}])"))
    return (F.trim(needle) != "") & F.rlike(text, bounded)


def snippet(text: Column, terms: list[str], size: int = 180) -> Column:
    """A window of the stripped text around the first term (in the given order) that occurs, with ... where it is cut."""
    plain = strip_markdown(text)
    # Marks stay here, so that places are those of the text shown; a term's letters may have some after them.
    folded = F.lower(F.translate(plain, MARKED, PLAIN))
    at = F.lit(0)
    for term in reversed(terms):
        place = F.regexp_instr(folded, F.lit("[\\u0300-\\u036F]*".join(re.escape(c) for c in term)))
        at = F.when(place > 0, place - 1).otherwise(at)
    n = F.char_length(plain)
    start = F.greatest(F.lit(0), at - size // 2)
    start = F.when(n - start < size, F.greatest(F.lit(0), n - size)).otherwise(start)
    stop = F.least(n, start + size)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(plain, start + 1, stop - start), F.when(stop < n, "...").otherwise(""))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(path, 256), 1, 16))


def normalize_id(identifier: Column) -> Column:
    return F.when(identifier.startswith("doc_") & (F.char_length(identifier) > 20), F.substring(identifier, 1, 20)).otherwise(identifier)


def is_exact_code(term: Column) -> Column:
    return term.rlike("^[A-Za-z0-9_-]{3,}$") & term.rlike("[-_0-9]")


def embedding_text(title: Column, category: Column, locator: Column, passage: Column) -> Column:
    """The passage under a context line of at most a fifth of its length; a blank passage or context adds nothing."""
    parts = F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in (title, category, locator))), lambda x: x != "")
    context = F.substring(F.array_join(parts, "\n"), F.lit(1), F.floor(F.char_length(passage) * 0.2).cast("int"))
    return F.when((F.trim(passage) == "") | (context == ""), passage).otherwise(F.concat(context, F.lit("\n"), passage))


def redact(text: Column) -> Column:
    """Keys and bearer tokens replaced; ``token = "hex"`` is an extension for plain assignments."""
    for pattern, put in (("sk-[A-Za-z0-9_-]{12,}", "[REDACTED_API_KEY]"), ("(?i)Bearer\\s+[A-Za-z0-9._-]+", "Bearer [REDACTED_TOKEN]"), ('token = "[0-9a-f]{16,}"', 'token = "[REDACTED]"')):
        text = F.regexp_replace(text, pattern, put)
    return text


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 30)


def content_words(text: Column) -> Column:
    """Distinct words of an overlap check: folded ASCII words of at least three characters that aren't stop words."""
    words = F.split(F.regexp_replace(fold(text), "[^a-z0-9\\s]", " "), "\\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(WORD_STOPS)))


def word_set(text: Column) -> Column:
    """Distinct words of a diversity check: content words that aren't numbers."""
    return F.filter(content_words(text), lambda w: ~w.rlike("^[0-9]+$"))


def is_sync_path(path: Column) -> Column:
    """What a release may hold: under 1024 bytes, at most 32 parts, none empty or hidden; no backslash or NUL."""
    parts = F.split(path, "/")
    clean = F.forall(parts, lambda p: (p != "") & ~p.startswith("."))
    return (F.octet_length(path) < 1024) & (F.size(parts) <= 32) & clean & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\0"))


def is_note_path(path: Column) -> Column:
    """A safe path under one of the vault's folders."""
    return is_safe_path(path) & F.substring_index(path, "/", 1).isin(*FOLDERS)


def rfc3339(millis: Column) -> Column:
    """A time in milliseconds since 1970 as text, in UTC."""
    whole = F.timestamp_seconds(F.floor(millis / 1000))
    utc = F.date_format(F.to_utc_timestamp(whole, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(utc, F.lit("."), F.lpad(F.pmod(millis, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def collision_key(path: Column) -> Column:
    """Composed (NFC) and lower-cased; only paths beyond ASCII leave the JVM."""
    return F.lower(F.when(path.rlike("[^\\x00-\\x7F]"), composed(path)).otherwise(path))


def is_safe_path(path: Column) -> Column:
    """At least two parts; none empty, . or ..; no backslash or NUL."""
    parts = F.split(path, "/")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\0"))


def cents(x: Column) -> Column:
    """Rounded to two decimals, halves up."""
    return F.floor(x * 100 + 0.5) / 100
