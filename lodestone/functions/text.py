"""String expressions: trimming, names, fingerprints, tokens, prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.binding import let

# Unicode White_Space, the set both the expressions and the Python helpers trim.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PIPELINE_VERSION = "1"


def trim_unicode(c: Column) -> Column:
    """Strip Unicode white space from both ends (``F.trim`` only strips blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def slugify(c: Column) -> Column:
    """Lower-case, runs outside ``[a-z0-9]`` become ``_``, outer ``_`` removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slugify_ascii(c: Column) -> Column:
    """The evaluation variant: non-ASCII letters are dropped before lower-casing."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def table_name(name: Column, collection_id: Column) -> Column:
    return F.concat(slugify(name), F.lit("_"), F.substring(collection_id, 1, 8))


def name_from_uri(uri: Column) -> Column:
    """Last path segment without its final extension."""
    path = F.regexp_replace(F.regexp_replace(uri, "^upload://", ""), "/+$", "")
    segment = F.regexp_extract(path, "([^/]*)$", 1)
    stem = F.regexp_replace(segment, r"\.[^.]*$", "")
    return F.when(uri.rlike("^(upload://)?/+$") & ~uri.rlike("^upload://$"), "/").when(stem == ".", "").otherwise(stem)


def fingerprint(text: Column, strategy, size, overlap) -> Column:
    """SHA-256 of pipeline version, configured chunking and the embedded text."""
    parts = [F.lit(PIPELINE_VERSION), _col(strategy), _col(size), _col(overlap), text]
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def embedded_text(header: Column, text: Column) -> Column:
    """What the embedder sees: the breadcrumb, when there is one, above the text."""
    return F.concat_ws("\n", header, text)


def breadcrumb(heading: Column) -> Column:
    """``"# A\\n## B"`` to ``"A > B"``."""
    titles = F.transform(F.split(heading, "\n"), lambda h: F.regexp_replace(h, "^[# ]+", ""))
    return F.array_join(F.filter(titles, lambda t: t != ""), " > ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def term_counts(words: Column) -> Column:
    """Every distinct token of an array with its count: the runs of the sorted tokens, inside the row."""
    ordered = F.sort_array(words)

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        counted = lambda s: F.transform(
            s, lambda a, k: F.struct(F.get(t, a - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t) + 1) - a).alias("tf"))
        )
        return let(starts, counted)

    # A sequence from 1 to 0 would count down.
    return F.when(F.size(words) > 0, let(ordered, runs))


def hash_api_key(plaintext: Column) -> Column:
    return F.sha2(plaintext, 256)


def key_hint(plaintext: Column) -> Column:
    return F.when(F.length(plaintext) < 4, plaintext).otherwise(F.right(plaintext, F.lit(4)))


def context_block(position: Column, source: Column, header: Column, text: Column) -> Column:
    """One retrieved chunk as it appears in a prompt; ``position`` counts from 1."""
    label = F.concat(F.lit("[Source "), position.cast("string"), F.lit(": "), source, F.lit("]"))
    section = F.when(
        F.coalesce(header, F.lit("")) != "", F.concat(F.lit("[Section: "), header, F.lit("]"))
    )
    return F.concat_ws("\n", label, section, F.coalesce(text, F.lit("")))


CONTEXT_SEPARATOR = "\n\n---\n\n"


def render_prompt(template: Column, context: Column, question: Column) -> Column:
    """Fill ``{{context}}`` first, then ``{{question}}`` (also inside the context)."""
    filled = F.replace(template, F.lit("{{context}}"), context)
    return F.replace(filled, F.lit("{{question}}"), question)


def echo_answer(prompt: Column) -> Column:
    """The offline completion stub: a fixed lead-in and the prompt's first 40 bytes."""
    head = F.substring(F.encode(prompt, "UTF-8"), 1, 40)
    return F.concat(F.lit("fake answer for: "), F.make_valid_utf8(head.cast("string")))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
