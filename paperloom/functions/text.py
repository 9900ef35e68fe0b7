"""String functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and expansions that results depend on.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "is", "are", "was", "be", "as", "its",
    "it", "this", "that", "these", "those", "into", "about", "but", "not",
)
TITLE_STOPWORDS = (
    "a", "an", "the", "for", "of", "on", "in", "and", "or", "to", "with", "from", "survey", "review", "systematic", "literature",
    "comprehensive", "overview", "study", "towards", "via", "using", "based", "approach", "approaches", "generation", "retrieval",
    "augmented", "retrievalaugmented",
)
TITLE_ACRONYMS = {
    "aigc": "ai generated content", "llms": "large language models", "llm": "large language model",
    "mllms": "multimodal large language models", "mllm": "multimodal large language model", "cais": "compound ai systems",
    "rag": "retrieval augmented generation", "qa": "question answering", "kg": "knowledge graph",
    "nlp": "natural language processing", "mcp": "model context protocol",
}
ABBREVIATIONS = {
    "ai": "artificial intelligence", "ml": "machine learning", "llm": "large language model", "llms": "large language models",
    "nlp": "natural language processing", "cv": "computer vision", "dl": "deep learning", "rl": "reinforcement learning",
    "rag": "retrieval augmented generation", "gnn": "graph neural network", "gnns": "graph neural networks",
}
QUERY_FILLER = (
    "systems", "system", "methods", "method", "approaches", "approach", "based", "using", "modern", "comprehensive", "a", "an", "the",
    "for", "of", "on", "in", "and", "or", "to", "with",
)
QUERY_ACRONYMS = {
    "rag": "retrieval augmented generation", "llm": "large language model", "llms": "large language models",
    "mllm": "multimodal large language model", "nlp": "natural language processing", "kg": "knowledge graph",
    "qa": "question answering", "cv": "computer vision", "rl": "reinforcement learning",
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(x), F.lit(""))


def normalized_title(x: Column | str) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(x)), r"(?U)\s+", " "))


def words(x: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit("([a-z0-9]+)"), F.lit(1))


def alphanumeric(x: Column | str) -> Column:
    """Those runs, one space between them."""
    return F.array_join(words(x), " ")


def drop_words(tokens: Column, stop: tuple[str, ...]) -> Column:
    """Without stop words and one-letter words; repeats stay."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def topic_tokens(topic: Column | str) -> Column:
    return drop_words(words(topic), STOPWORDS)


def expand(tokens: Column, acronyms: dict[str, str]) -> Column:
    """Each acronym as its words."""
    table = F.create_map(*[F.lit(x) for pair in acronyms.items() for x in pair])
    return F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(F.try_element_at(table, t), t), " ")))


def title_signature(x: Column | str) -> Column:
    """The telling words of a title."""
    return F.array_join(drop_words(expand(words(x), TITLE_ACRONYMS), TITLE_STOPWORDS), " ")


def expand_abbreviations(x: Column | str) -> Column:
    """Lower case with whole-word abbreviations spelled out, in their order."""
    return reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", kv[1]), ABBREVIATIONS.items(), F.lower(col(x)))


def query_variants(topic: Column | str) -> Column:
    """Search strings of a topic, most specific first: spelled out, with acronyms, and without the leading word if over three remain."""
    own = words(topic)
    full, short = drop_words(expand(own, QUERY_ACRONYMS), QUERY_FILLER), drop_words(own, QUERY_FILLER)
    text = lambda a: F.concat(F.array_join(a, " "), F.lit(" survey"))
    return F.array_distinct(
        F.array_compact(F.array(F.when(F.size(full) > 0, text(full)), F.when(F.size(short) > 0, text(short)), F.when(F.size(full) > 3, text(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))))))
    )


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the text as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term occurs: one pass of a quoted alternation."""
    import re

    return text.rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)


def truncate(x: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(col(x)) > n, F.concat(F.substring(col(x), 1, n - 1), F.lit("…"))).otherwise(col(x))


def short_title(x: Column | str, n: int) -> Column:
    """The first ``n`` words, with an ellipsis where more follow."""
    w = F.split(F.trim(col(x)), r"\s+")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))).otherwise(col(x))


def slug(x: Column | str, n_words: int, drop: tuple[str, ...] = ()) -> Column:
    """Lower-case words joined by hyphens, punctuation dropped, at most ``n_words``."""
    plain = F.filter(F.split(F.regexp_replace(F.lower(col(x)), r"[^\w\s-]", ""), r"[\s_-]+"), lambda t: (t != "") & ~t.isin(*drop) if drop else t != "")
    return F.array_join(F.slice(plain, 1, n_words), "-")


def paper_slug(x: Column | str, width: int = 80) -> Column:
    """A file name of at most ``width`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, width)


def anchor(title: Column | str, year: Column | str) -> Column:
    """The first six words and the year, or "nd"."""
    return F.concat_ws("-", F.array_join(F.slice(words(title), 1, 6), "-"), F.coalesce(col(year).cast("string"), F.lit("nd")))


# Abbreviations after which a full stop ends no sentence.
NO_STOP = ("e.g.", "i.e.", "etc.", "vs.", "cf.", "et al.", "al.", "Fig.", "Eq.", "Sec.", "approx.", "Ref.", "No.", "Dr.", "Mr.", "Ms.", "Prof.")


# Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def folded(x: Column | str) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def sentences(x: Column | str) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` before a capital or digit, but not after an abbreviation."""
    guarded = reduce(lambda c, a: F.replace(c, F.lit(a), F.lit(a.replace(".", "\u0001"))), NO_STOP, col(x))
    parts = F.split(guarded, SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def bullets(x: Column | str, most: int = 6) -> Column:
    """At most ``most`` sentences of the folded text; what is over joins the last."""
    s = sentences(folded(x))
    return F.when(F.size(s) <= most, s).otherwise(F.concat(F.slice(s, 1, most - 1), F.array(F.array_join(F.slice(s, F.lit(most), F.greatest(F.size(s) - most + 1, F.lit(0))), " "))))


def strip_fences(x: Column | str) -> Column:
    """The text within the first pair of code fences, without a leading ``json``; the text itself where it has none."""
    t = F.trim(col(x))
    inner = F.coalesce(F.try_element_at(F.split(t, "```"), F.lit(2)), F.lit(""))
    return F.when(F.startswith(t, F.lit("```")), F.trim(F.regexp_replace(inner, "^json", ""))).otherwise(t)


def doi(x: Column | str) -> Column:
    """Without the resolver's address; null if nothing is left."""
    c = F.regexp_replace(col(x), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(c != "", c)


def arxiv_id(x: Column | str) -> Column:
    """The last part of a path or address, cut at its first ``v``."""
    c = F.split_part(F.element_at(F.split(col(x), "/"), -1), F.lit("v"), F.lit(1))
    return F.when(c != "", c)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def response_key(*parts: Column) -> Column:
    """The first 16 digits of :func:`cache_key`."""
    return F.substring(cache_key(*parts), 1, 16)


def escape_html(x: Column | str) -> Column:
    """For text and attributes."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(x))


def diagram_label(x: Column | str, width: int = 48) -> Column:
    """A label without characters that diagrams give a meaning; a dash if nothing is left."""
    t = F.translate(F.trim(F.regexp_replace(col(x), r"\s+", " ")), '"`[]{}|', "''()()/")
    t = truncate(F.replace(t, F.lit("#"), F.lit("no.")), width)
    return F.when(t == "", "—").otherwise(t)


def node_id(x: Column | str) -> Column:
    """An identifier of letters, digits and underscores."""
    return F.regexp_replace(col(x), r"[^A-Za-z0-9]+", "_")
