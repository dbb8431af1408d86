"""Text normalisation, redaction, digests, cache keys, split buckets and hashed features."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction patterns, as the data contract states them.
SECRET = r"(?U)\b(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{12,}|Bearer\s+[A-Za-z0-9._-]+)\b"
EMAIL = r"(?Ui)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact(text: Column | str, phone: bool = True) -> Column:
    """The text with [SECRET], [EMAIL] and [PHONE], in that order."""
    out = F.regexp_replace(F.regexp_replace(col(text), SECRET, "[SECRET]"), EMAIL, "[EMAIL]")
    return F.regexp_replace(out, PHONE, "[PHONE]") if phone else out


def redact_nested(value: Column, kind: T.DataType, phone: bool = True) -> Column:
    """Every text inside a value of the given type is redacted, at any depth; map keys and field names stay."""
    if isinstance(kind, T.StringType):
        return redact(value, phone)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType, phone))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: redact_nested(x, kind.valueType, phone))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redact_nested(value[f.name], f.dataType, phone).alias(f.name) for f in kind)))
    return value


def normalize_state(text: Column | str) -> Column:
    """White space as single blanks, ends trimmed, case kept."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose case folding is one other character, and those that several come of."""
    folded = {c: f for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c}
    return {c: f for c, f in folded.items() if len(f) == 1}, {c: f for c, f in folded.items() if len(f) > 1}


def casefold(text: Column | str) -> Column:
    """Unicode's full case folding: for comparisons that ignore case, as of the sharp s and two s.

    Texts of Latin letters, Hangul and Han are lowered. Others are translated character by
    character; only where one folds to several are characters looked up.
    """
    one, several = _foldings()
    x = col(text)
    told = F.translate(x, "".join(one) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(one.values()) + "abcdefghijklmnopqrstuvwxyz")
    images = F.create_map(*(F.lit(t) for pair in several.items() for t in pair))
    longer = F.array_join(F.transform(F.split(told, ""), lambda c: F.coalesce(F.try_element_at(images, c), c)), "")
    # of these characters lower case is all but for the sharp s
    easy = ~x.rlike("[^\\x00-\u024f\u2000-\u206f\u3000-\u9fff\uac00-\ud7a3]|[\u00b5\u0130\u0149\u017f\u01f0]")
    return F.when(easy, F.replace(F.lower(x), F.lit("\u00df"), F.lit("ss"))).when(told.rlike(f"[{''.join(several)}]"), longer).otherwise(told)


def normalize_prompt(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


_BARE = [c for c in range(32) if chr(c) not in "\b\t\n\f\r"]


def json_string(text: Column | str) -> Column:
    """A JSON string literal; non-ASCII characters stay as they are, control characters are escaped."""
    out = F.replace(F.replace(col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    # the rest of them are rare: one pass tells whether there are any
    bare = lambda x: F.aggregate(F.array(*(F.lit(chr(c)) for c in _BARE)), x, lambda a, c: F.replace(a, c, F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))))
    out = F.element_at(F.transform(F.array(out), lambda x: F.when(x.rlike(r"[\x00-\x1f]"), bare(x)).otherwise(x)), 1)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_object(**fields: Column) -> Column:
    """Keys in order of name, ``", "`` and ``": "`` between; values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def digest(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def state_cache_key(model: Column | str, state: Column | str) -> Column:
    return digest(json_object(kind=F.lit('"state"'), model_version=json_string(model), state=json_string(normalize_state(state))))


def question_cache_key(task: Column | str, question: Column | str, candidates: Column | None = None) -> Column:
    listed = F.lit("[]") if candidates is None else F.concat(F.lit("["), F.array_join(F.transform(candidates, json_string), ", "), F.lit("]"))
    return digest(json_object(kind=F.lit('"question"'), task=json_string(task), question=json_string(normalize_state(question)), candidates=listed))


def result_cache_key(model: Column | str, calibration: Column | str, state_key: Column | str, question_key: Column | str) -> Column:
    return digest(
        json_object(
            kind=F.lit('"result"'), model_version=json_string(model), calibration_version=json_string(calibration),
            state_key=json_string(state_key), question_key=json_string(question_key),
        )
    )


def request_id(payload: Column | str) -> Column:
    return F.concat(F.lit("req-"), F.substring(digest(payload), 1, 24))


def short_id(payload: Column | str, prefix: str = "", digits: int = 16) -> Column:
    """The first digits of the payload's SHA-256 behind a prefix."""
    return F.concat(F.lit(prefix), F.substring(digest(payload), 1, digits))


def split_group(fields: list[Column | str], content: Column) -> Column:
    """JSON of what keeps samples in one split: the first field that says something, else the content."""
    first = truthy(*fields)
    return F.when(first.isNotNull(), json_string(first)).otherwise(content)


def hash_number(text: Column | str) -> Column:
    """The first 32 bits of the text's SHA-256 as a number."""
    return F.conv(F.substring(digest(text), 1, 8), 16, 10).cast("bigint")


def truthy(*candidates: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in candidates))


def split_of(group: Column | str) -> Column:
    """train, validation or test by the group's hash: 80, 10 and 10 of 100."""
    return split_of_json(json_string(group))


def split_of_json(group: Column) -> Column:
    """:func:`split_of` for a group that is JSON already."""
    bucket = hash_number(group) % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def feature_id(token: Column, vocabulary: int, prefix: str = "") -> Column:
    """2 and up by the token's hash; 0 and 1 are padding and unknown."""
    return (F.lit(2) + hash_number(F.concat(F.lit(prefix), token)) % (vocabulary - 2)).cast("int")


def word_features(text: Column | str, vocabulary: int = 4096, most: int = 1024) -> Column:
    return F.transform(F.slice(words(text), 1, most), lambda w: feature_id(w, vocabulary))


def control_features(state: Column | str, question: Column | str, vocabulary: int = 4096, most: int = 1024) -> Column:
    """Words of the state alone: control questions say all the same."""
    return word_features(state, vocabulary, most)


def char_ngrams(text: Column | str, narrow: int = 2, wide: int = 5) -> Column:
    """Of each word in ^ and $, all n-grams, by width and then by place."""

    def of_word(w: Column) -> Column:
        marked = F.concat(F.lit("^"), w, F.lit("$"))
        by_width = F.transform(
            F.sequence(F.lit(narrow), F.lit(wide)),
            lambda n: F.when(
                F.length(marked) >= n,
                F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1)), lambda i: F.substring(marked, i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
        return F.flatten(by_width)

    return F.flatten(F.transform(words(text), of_word))


def char_features(text: Column | str, vocabulary: int = 4096, most: int = 1024) -> Column:
    return F.transform(F.slice(char_ngrams(text), 1, most), lambda g: feature_id(g, vocabulary))


def hybrid_features(text: Column | str, vocabulary: int = 4096, most: int = 1024) -> Column:
    """Words in the lower half of the ids, n-grams in the upper half."""
    half = vocabulary // 2
    left = F.transform(words(text), lambda w: feature_id(w, half, "w:"))
    right = F.transform(char_ngrams(text), lambda g: feature_id(g, half, "c:") + half - 2)
    return F.slice(F.concat(left, right), 1, most)


def segmented_features(state: Column | str, question: Column | str, vocabulary: int = 4096, most: int = 1024) -> Column:
    half = vocabulary // 2
    left = F.transform(words(state), lambda w: feature_id(w, half, "s:"))
    right = F.transform(words(question), lambda w: feature_id(w, half, "q:") + half - 2)
    return F.slice(F.concat(left, right), 1, most)


def byte_features(text: Column | str, vocabulary: int = 258, most: int = 1024) -> Column:
    raw = F.hex(F.encode(col(text), "utf-8"))
    n = F.least(F.length(raw) / 2, F.lit(most)).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: (F.lit(2) + F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % (vocabulary - 2)).cast("int"))


#: Features by the name of a model's backbone, over a state and a question.
BACKBONES = {
    "byte": lambda s, q: byte_features(F.concat_ws("\n", s, q)), "word": lambda s, q: word_features(F.concat_ws("\n", s, q)), "char": lambda s, q: char_features(F.concat_ws("\n", s, q)),
    "hybrid": lambda s, q: hybrid_features(F.concat_ws("\n", s, q)), "segmented": lambda s, q: segmented_features(s, q), "control": lambda s, q: control_features(s, q),
}


def features(backbone: str, state: Column, question: Column) -> Column:
    if backbone not in BACKBONES:
        raise ValueError(f"unknown backbone: {backbone}")
    return BACKBONES[backbone](state, question)


def padded(ids: Column, most: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(most) - F.size(ids), F.lit(0))))


def attention(ids: Column, most: int) -> Column:
    n = F.least(F.size(ids), F.lit(most))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(most) - n))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms is in the text, which is evaluated once."""
    return F.element_at(F.transform(F.array(text), lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t))), 1)
