r"""Column functions over terms in N3 text: ``<uri>``, ``_:b``, ``"lit"``, ``"lit"@en``, ``"lit"^^<type>``.

All of them stay inside Spark's own expressions.  A null term gives null everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkedframe.config import RDFS_NAMESPACES, Config

BLANK_PAGE = "<BLANK>"

# The bytes whose percent-encoding is never undone in a URI, and the characters that, like white space,
# are always encoded.
KEPT_ENCODED = (
    "%23|%25|%2F|%3B|%3F|%2B|%22|%3C|%3E|%7B|%7D|%5C|%5E|%5B|%5D|"
    "%C2%A0|%E1%9A%80|%E1%A0%8E|%E2%80%8[0-9AB]|%E2%80%AF|%E2%81%9F|%E3%80%80|%EF%BB%BF"
)
DANGEROUS = '"<>{}[]|\\'


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(c: Column, form: Callable[[Column], Column]) -> Column:
    """``form`` of a value that is worked out once, however often ``form`` takes it."""
    return F.get(F.transform(F.array(c), form), F.lit(0))


def _suffix(n3: Column) -> Column:
    """What stands behind the closing quote: it is the last one, since neither tags nor type URIs have any."""
    return F.substring_index(n3, '"', -1)


def term_type(n3: str | Column) -> Column:
    """``uri``, ``bnode`` or ``literal``; null if it is none of them."""
    c = _col(n3)
    return F.when(c.startswith("<"), "uri").when(c.startswith("_:"), "bnode").when(c.startswith('"'), "literal")


def term_value(n3: str | Column) -> Column:
    """The URI, the blank node's name, or the literal's text without escapes."""
    c = _col(n3)
    body = F.substring(c, F.lit(2), F.length(c) - F.length(_suffix(c)) - 2)
    return (
        F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2))
        .when(c.startswith("_:"), F.substring(c, F.lit(3), F.length(c)))
        .when(c.startswith('"'), unescape_literal(body))
    )


def uri_value(n3: str | Column) -> Column:
    """The URI of a URI term, else null."""
    c = _col(n3)
    return F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2))


def term_lang(n3: str | Column) -> Column:
    """Language tag in lower case, or null."""
    c = _col(n3)
    tag = _suffix(c)
    return F.when(c.startswith('"') & tag.startswith("@"), lower_lang(F.substring(tag, F.lit(2), F.length(tag))))


def term_datatype(n3: str | Column) -> Column:
    """Type URI, or null."""
    c = _col(n3)
    tag = _suffix(c)
    return F.when(c.startswith('"') & tag.startswith("^^<"), F.substring(tag, F.lit(4), F.length(tag) - 4))


def term(n3: str | Column) -> Column:
    """struct<type, value, lang, datatype>."""
    return F.struct(term_type(n3).alias("type"), term_value(n3).alias("value"), term_lang(n3).alias("lang"), term_datatype(n3).alias("datatype"))


def escape_literal(text: str | Column) -> Column:
    """The canonical escapes of N-Triples."""
    c = _col(text)
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def to_n3(type_: str | Column, value: str | Column, lang: Column | None = None, datatype: Column | None = None) -> Column:
    """The text of a term from its parts."""
    t, v = _col(type_), _col(value)
    none = F.lit(None).cast("string")
    lang, datatype = (none if x is None else x for x in (lang, datatype))
    tag = F.when(F.length(lang) > 0, F.concat(F.lit("@"), lower_lang(lang))).when(F.length(datatype) > 0, F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(t == "uri", F.concat(F.lit("<"), v, F.lit(">"))).when(t == "bnode", F.concat(F.lit("_:"), v)).when(t == "literal", F.concat(F.lit('"'), escape_literal(v), F.lit('"'), tag))


_HEX = "[0-9A-Fa-f]"
_ONE = rf"\\u(?:[0-9A-CE-Fa-ce-f]{_HEX}{{3}}|[Dd][0-7]{_HEX}{{2}})"
_PAIR = rf"\\u[Dd][89ABab]{_HEX}{{2}}\\u[Dd][C-Fc-f]{_HEX}{{2}}"
_LONG = rf"\\U00(?:0{_HEX}|10){_HEX}{{4}}"


def _decoded(c: Column, short: dict[str, str]) -> Column:
    """Escapes to characters; what is no escape stays as it is."""
    short_pattern = r"\\[" + "".join("\\\\" if k == "\\" else k for k in short) + "]|" if short else ""
    parts = F.regexp_extract_all(c, F.lit(rf"((?:{_ONE}|{_PAIR})++|{_LONG}|{short_pattern}\\|[^\\]+)"), F.lit(1))

    def character(p: Column) -> Column:
        out = F.when(p.startswith("\\u") & (F.length(p) >= 6), F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        out = out.when(p.startswith("\\U") & (F.length(p) == 10), F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32"))
        for name, value in short.items():
            out = out.when(p == f"\\{name}", value)
        return out.otherwise(p)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, character), "")).otherwise(c)


def unescape_unicode(text: str | Column) -> Column:
    r"""``\uXXXX`` (surrogates by pairs) and ``\UXXXXXXXX`` to characters; anything else is left alone."""
    return _decoded(_col(text), {})


def unescape_literal(text: str | Column) -> Column:
    r"""All N-Triples escapes to characters: ``\t \b \n \r \f \" \' \\`` and those of :func:`unescape_unicode`."""
    return _decoded(_col(text), {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"})


def literal_display(text: str | Column) -> Column:
    """A literal's text for display; a second unescape for data whose escapes were kept raw."""
    return _decoded(_col(text), {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"})


def safe_path(text: str | Column) -> Column:
    """Percent-encodes the dangerous characters and white space (a space as ``+``)."""
    unsafe = "[" + re.escape(DANGEROUS) + r"\s\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    parts = F.regexp_extract_all(_col(text), F.lit(f"({unsafe}|[^{unsafe[1:]}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{unsafe}$"), F.url_encode(p)).otherwise(p)), "")


def safe_uri(uri: str | Column) -> Column:
    """A URI with dangerous characters encoded, and all encodings undone but those that would change its meaning.

    A URI with broken percent-encoding is only encoded.
    """
    encoded = safe_path(uri)
    guarded = F.transform(
        F.regexp_extract_all(encoded, F.lit(rf"((?i:{KEPT_ENCODED})|[^%]+|%)"), F.lit(1)),
        lambda p: F.when(F.length(p) >= 3, F.when(p.startswith("%"), F.replace(p, F.lit("%"), F.lit("%25"))).otherwise(p)).otherwise(p),
    )
    plain = F.replace(F.array_join(guarded, ""), F.lit("+"), F.lit("%20"))
    return F.coalesce(F.replace(F.try_url_decode(plain), F.lit(" "), F.lit("+")), encoded)


def page_of(uri: str | Column, cfg: Config) -> Column:
    """Page id of a URI under the base: without base and fragment; null for others."""
    c = _col(uri)
    return F.when(c.startswith(cfg.base), F.substring_index(F.substring(c, F.lit(len(cfg.base) + 1), F.length(c)), "#", 1))


def fragment_of(uri: str | Column) -> Column:
    """What stands behind the first ``#``; null without one."""
    c = _col(uri)
    return F.when(c.contains("#"), F.substring(c, F.instr(c, "#") + 1, F.length(c)))


def strip_format_suffix(page: str | Column) -> Column:
    return F.regexp_replace(_col(page), r"\.(rdf|ttl|nt|json|xml)$", "")


def main_of(n3: str | Column) -> Column:
    """A URI term without its fragment; other terms as they are."""
    c = _col(n3)
    return F.when(c.startswith("<") & c.contains("#"), F.concat(F.substring_index(c, "#", 1), F.lit(">"))).otherwise(c)


def remove_fragment(uri: str | Column) -> Column:
    return F.substring_index(_col(uri), "#", 1)


#: Prefixes up to which they are tried one by one; more are looked up in a sorted list of bounds.
FEW = 24


def _behind(prefix: str) -> str | None:
    """The first text, in the order of code points, that sorts behind all that start with ``prefix``."""
    for i in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[i]) + 1
        if point <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= point < 0xE000 else point)
    return None


def first_prefix(text: str | Column, prefixes: Sequence[str]) -> Column:
    """The number, from 0, of the first of ``prefixes`` that a text starts with; null without one.

    Which of them a text starts with follows from where it sorts among their bounds, so that is found by halving: one
    expression of log2(n) comparisons, of which the bounds are a constant.  Prefixes must not hold line ends.
    """
    c = _col(text)
    if len(prefixes) <= FEW:
        return F.coalesce(*[F.when(c.startswith(p), F.lit(i)) for i, p in enumerate(prefixes)], F.lit(None).cast("int"))
    number = {p: i for i, p in reversed(list(enumerate(prefixes)))}
    sizes = sorted({len(p) for p in prefixes})
    bounds = sorted({*prefixes, *filter(None, map(_behind, prefixes))})
    answers = [min((number[b[:n]] for n in sizes if n <= len(b) and b[:n] in number), default=-1) for b in bounds]
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    listed = _constants(bounds)
    passed = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(listed, at + step - 1) <= c, F.lit(False)), at + step).otherwise(at))
    return F.nullif(F.get(_constants(map(str, answers)).cast("array<int>"), passed - 1), F.lit(-1))


def _constants(values: Iterable[str]) -> Column:
    """An array of texts, as one constant."""
    return F.split(F.lit("\n".join(values)), "\n")


def _with_prefix(c: Column, prefixes: Sequence[str], form: Callable[[Column, int | Column, str | Column], Column], names: Sequence[str] | None = None) -> Column:
    """``form`` of the text, of the length of its first prefix and of that one's name; null without a prefix."""
    names = prefixes if names is None else names
    if len(prefixes) <= FEW:
        return F.coalesce(*[F.when(c.startswith(p), form(c, F.lit(len(p)), F.lit(n))) for p, n in zip(prefixes, names, strict=True)], F.when(F.lit(False), form(c, F.lit(0), F.lit(""))))
    at = first_prefix(c, prefixes)
    return F.when(at.isNotNull(), form(c, F.get(_constants(str(len(p)) for p in prefixes).cast("array<int>"), at), F.get(_constants(names), at)))


def link_target(uri: str | Column, cfg: Config) -> Column:
    """The dataset that an outside URI belongs to: the first linked set that is a prefix, else ``scheme://authority/``.

    Null for URIs that are not HTTP, under the base or in a namespace that is not counted, or broken.
    """
    c = _col(uri)
    skipped = ~c.startswith("http") | first_prefix(c, (cfg.base, *cfg.not_linked)).isNotNull()
    host = F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("/"))
    return F.when(~skipped, F.coalesce(_with_prefix(c, cfg.linked_sets, lambda c, n, name: name), host))


def name(page: str | Column, fragment: str | Column | None, cfg: Config) -> Column:
    """The term of a page and fragment; a fragment of the blank page is a blank node."""
    p = _col(page)
    f = F.lit(None).cast("string") if fragment is None else _col(fragment)
    uri = F.concat(F.lit(f"<{cfg.base}"), p, F.when(F.length(f) > 0, F.concat(F.lit("#"), f)).otherwise(""), F.lit(">"))
    return F.when(p == BLANK_PAGE, F.concat(F.lit("_:"), f)).otherwise(uri)


def magic_string(text: str | Column) -> Column:
    """camelCase and ``_`` to words, percent-decoded, first letter upper case.  Broken encodings stay."""

    def decoded(c: Column) -> Column:
        return F.when(c.contains("%") | c.contains("+"), F.coalesce(F.try_url_decode(c), c)).otherwise(c)

    def capital(c: Column) -> Column:
        return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))

    def words(c: Column) -> Column:
        return F.replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))

    return _once(_col(text), lambda c: F.when(c.rlike("[_%+]|[a-z][A-Z]"), _once(_once(words(c), decoded), capital)).otherwise(capital(c)))


def _display(uri: Column, cfg: Config, label: Column | None, pretty: bool) -> Column:
    def behind(uri: Column, n: Column) -> Column:
        rest = F.substring(uri, n + 1, F.length(uri))
        return magic_string(rest) if pretty else rest

    def local(prefix: str) -> Column:
        return behind(uri, F.lit(len(prefix)))

    forms = [F.when(uri == k, F.lit(v)) for k, v in cfg.prop_names.items()]
    forms.append(_with_prefix(uri, list(cfg.prefixes.values()), lambda c, n, qn: behind(c, n) if pretty else F.concat(qn, F.lit(":"), behind(c, n)), list(cfg.prefixes)))
    under = local(cfg.base) if label is None else F.coalesce(F.nullif(label, F.lit("")), local(cfg.base))
    forms.append(F.when(uri.startswith(cfg.base), under))
    for qn, (prefix, bare) in RDFS_NAMESPACES.items():
        forms.append(F.when(uri.startswith(prefix), local(prefix) if pretty or bare else F.concat(F.lit(f"{qn}:"), local(prefix))))
    return F.coalesce(_once(F.coalesce(*forms), lambda c: F.nullif(c, F.lit(""))), uri)


def display_default(uri: str | Column, cfg: Config, label: Column | None = None) -> Column:
    """Name of a URI: a forced name, ``qn:rest``, its label (for URIs under the base), a local name, or the URI."""
    return _display(_col(uri), cfg, label, pretty=False)


def display_pretty(uri: str | Column, cfg: Config, label: Column | None = None) -> Column:
    """As :func:`display_default`, local names by :func:`magic_string`."""
    return _display(_col(uri), cfg, label, pretty=True)


def display_node(n3: str | Column, cfg: Config, label: Column | None = None) -> Column:
    """Name of a term: URIs by the configured display, literals as text, blank nodes empty."""
    c = _col(n3)
    show = cfg.display or (lambda uri, label: _once(uri, lambda uri: display_pretty(uri, cfg, label)))
    return F.when(c.startswith("<"), show(uri_value(c), label)).when(c.startswith('"'), term_value(c)).otherwise("")


def expand(curie: str, prefixes: dict[str, str]) -> str:
    """``prefix:name`` to a URI; for pattern arguments, on the driver."""
    prefix, colon, rest = curie.partition(":")
    if not colon or prefix not in prefixes:
        raise ValueError(f"unknown prefix: {curie}")
    return prefixes[prefix] + rest


def expand_column(curie: str | Column, prefixes: dict[str, str]) -> Column:
    """``prefix:name`` to a URI; an unknown prefix gives null."""
    c = _col(curie)
    return _with_prefix(c, [f"{p}:" for p in prefixes], lambda c, n, space: F.concat(space, F.substring(c, n + 1, F.length(c))), list(prefixes.values()))


def compact(uri: str | Column, cfg: Config) -> Column:
    """struct<prefix, rest>: the base (null prefix) first, then the configured namespaces, else the whole URI."""
    c = _col(uri)
    none = F.lit(None).cast("string")

    def pair(c: Column, n: Column, prefix: Column) -> Column:
        return F.struct(prefix.alias("prefix"), F.substring(c, n + 1, F.length(c)).alias("rest"))

    spaces = _with_prefix(c, list(cfg.prefixes.values()), pair, list(cfg.prefixes))
    whole = F.struct(none.alias("prefix"), c.alias("rest"))
    return F.when(c.startswith(cfg.base), pair(c, F.lit(len(cfg.base)), none)).otherwise(F.coalesce(spaces, whole))


def short_name(uri: str | Column, cfg: Config) -> Column:
    """Context name of a property: behind the last ``#``, else behind the last ``/``, else its compacted rest."""
    c = _col(uri)
    word = r"^\w+$"
    by_hash, by_slash = F.substring_index(c, "#", -1), F.substring_index(c, "/", -1)
    return F.when(c.contains("#") & by_hash.rlike(word), by_hash).when(c.contains("/") & by_slash.rlike(word), by_slash).otherwise(compact(c, cfg)["rest"])


def uri_encode(text: str | Column) -> Column:
    return F.url_encode(_col(text))


def clean_uri(uri: str | Column) -> Column:
    """Without control characters, spaces and no-break spaces."""
    return F.regexp_replace(_col(uri), r"[\x00-\x20\xA0]", "")


def clip(text: str | Column, n: int = 100) -> Column:
    return F.substring(_col(text), 1, n)


def lower_lang(tag: str | Column) -> Column:
    return F.lower(_col(tag))


XSD = "http://www.w3.org/2001/XMLSchema#"


def native_integer(n3: str | Column) -> Column:
    """The value of an ``xsd:integer`` literal, else null."""
    return F.when(term_datatype(n3) == XSD + "integer", term_value(n3).try_cast("bigint"))


def native_double(n3: str | Column) -> Column:
    """The value of an ``xsd:double`` literal, else null."""
    return F.when(term_datatype(n3) == XSD + "double", term_value(n3).try_cast("double"))


def native_date(n3: str | Column) -> Column:
    """The value of an ``xsd:date`` literal, else null."""
    return F.when(term_datatype(n3) == XSD + "date", term_value(n3).try_cast("date"))


def lower_ascii(text: str | Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenize(text: str | Column) -> Column:
    """Runs of ASCII letters and digits and of any other non-ASCII characters; only A-Z become lower case."""
    return F.filter(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != "")
