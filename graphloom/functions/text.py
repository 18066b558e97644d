"""Column builders on text: normalisation, tags, templates and parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, articles, number-insensitive nouns, delimiters and tags of the prompt format.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
SYNONYMS = {"man": "men", "woman": "women"}
TUPLE_DELIMITER = "<|>"
SPACE = r"[\s ]+"


def tokens(text: Column) -> Column:
    """White-space separated tokens, none of them empty."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def answer_tokens(text: Column) -> Column:
    """Tokens of an answer, lower-cased, without punctuation and articles, with synonyms mapped. An article stands
    between characters that are neither letters nor digits, such as curly quotes and dashes."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    # most texts are ASCII once punctuation is gone; there an article is a token
    others = F.regexp_replace(plain, f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(ARTICLES)})(?![\\p{{L}}\\p{{N}}])", " ")
    kept = F.filter(tokens(F.when(plain.rlike("[^\\x20-\\x7E\\s]"), others).otherwise(plain)), lambda t: ~t.isin(*ARTICLES))

    def synonym(t: Column) -> Column:
        out = t
        for a, b in SYNONYMS.items():
            out = F.when(t == a, b).otherwise(out)
        return out

    return F.transform(kept, synonym)


def normalize_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def tag_contents(text: Column, tag: str) -> Column:
    """Contents of ``<tag>...</tag>`` within lines, joined by '; '."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1)), "; ")


def tag_list(text: Column, tag: str) -> Column:
    """Trimmed contents of a tag in any case, over lines."""
    found = F.regexp_extract_all(text, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", ""))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def entity_text(label: Column, description: Column) -> Column:
    """'label, description', 'missing' if both are absent, without outer blanks and full stops."""
    text = F.concat(F.coalesce(F.concat(label, F.lit(", ")), F.lit("")), F.coalesce(description, F.lit("")))
    text = F.when(text == "", "missing").otherwise(text)
    return F.btrim(F.btrim(text), F.lit("."))


def relation_words(rel: Column) -> Column:
    """Words of a relation name after its first, underscore-separated part."""
    parts = F.split(rel, "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " ")


def object_text(name: Column, attributes: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Text of a scene-graph object."""
    place = F.format_string("%s at coordinate (%d, %d) with width %d and height %d", name, x, y, w, h)
    return F.btrim(F.concat_ws(" ", F.array_join(attributes, ", "), place))


def key_text(entity: Column) -> Column:
    """Text of entities that are named by their key: without outer blanks and full stops."""
    return F.btrim(F.btrim(entity), F.lit("."))


def relation_question(source: Column, target: Column, candidates: Column, node: str = "word node") -> Column:
    """Asks for the relation of two entities, chosen from candidates."""
    # Fixed value: the question's wording.
    wording = f"What is the relation between {node} %s and {node} %s? Selected from the following candidate answers: %s."
    return F.format_string(wording, source, target, F.array_join(candidates, "; "))


STATIONS = r"(?is)How many stations are between\s+(.+?)\s+and\s+(.+?)\?"


def station_endpoint(question: Column, which: int) -> Column:
    """Endpoint 1 or 2 of a station question, null for other questions."""
    return F.when(question.rlike(STATIONS), F.regexp_extract(question, STATIONS, which))


def canonical_node_name(text: Column) -> Column:
    """The name before ' does not have ' or else ' has '."""
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    text = strip(text)
    cut = lambda mark: strip(F.substring_index(text, mark, 1))
    return F.when(text.contains(" does not have "), cut(" does not have ")).when(text.contains(" has "), cut(" has ")).otherwise(text)


def integer_label(text: Column) -> Column:
    """Integer value of a label, null if it isn't one."""
    return F.when(F.btrim(text).rlike("^[-+]?[0-9]+$"), F.btrim(text).try_cast("long"))


def after_last(text: Column, mark: str) -> Column:
    """What follows the last ``mark``."""
    return F.substring_index(text, mark, -1)


def qa_blocks(response: Column) -> Column:
    """array of struct(type, question, answer) of a response: pieces by the tuple delimiter, or by blank lines if
    there is one piece; pieces of three lines, their values after the last colon."""
    pieces = F.split(response, r"<\|>")
    pieces = F.when(F.size(pieces) == 1, F.split(response, "\n\n")).otherwise(pieces)
    lines = F.transform(pieces, lambda p: F.split(F.regexp_replace(p, r"^\s+|\s+$", ""), "\n"))
    value = lambda b, i: F.btrim(after_last(b[i], ":"))
    three = F.filter(lines, lambda b: F.size(b) == 3)
    return F.transform(three, lambda b: F.struct(value(b, 0).alias("type"), value(b, 1).alias("question"), value(b, 2).alias("answer")))


def qa_pair(response: Column) -> Column:
    """struct(question, answer) of two blocks parted by a blank line, null otherwise."""
    blocks = F.split(response, "\n\n")
    value = lambda i: F.btrim(after_last(blocks[i], ":"))
    return F.when(F.size(blocks) == 2, F.struct(value(0).alias("question"), value(1).alias("answer")))


def summary(response: Column) -> Column:
    """What follows the last 'Summary:', null if it has 5 characters or fewer."""
    text = F.btrim(after_last(response, "Summary:"))
    return F.when(F.length(text) > 5, text)


def append_end(text: Column, end: str) -> Column:
    """``text`` with ``end`` unless it has it."""
    return F.when(text.endswith(end), text).otherwise(F.concat(text, F.lit(end)))


def append_end_all(texts: Column, end: str) -> Column:
    """``append_end`` of each text of a list."""
    return F.transform(texts, lambda t: append_end(t, end))


def qa_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)
