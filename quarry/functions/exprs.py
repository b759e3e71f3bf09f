"""Column expressions of the catalogue: identity, SI magnitudes, tags, link policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI prefixes, the symbols that may follow one, qualifiers before a value.
SI_PREFIXES = {"p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
UNIT_SYMBOLS = "VΩFHAWsJ%"
QUALIFIERS = "±≤≥<>=≈~ "
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?"


def normalize(c: Column) -> Column:
    """Upper-case letters and digits alone; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def part_key(mpn: Column, maker: Column) -> Column:
    return F.concat_ws("|", normalize(mpn), normalize(maker))


def attr_name(c: Column) -> Column:
    """An attribute's name without bracketed remarks, lower-cased, single-spaced."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\s+", " ")))


def let(value: Column, f) -> Column:
    """``f`` of ``value``, which is worked out once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def magnitude(text: Column) -> Column:
    """SI magnitude of a value such as ``100nF`` or ``2V@1mA``; null for ranges and prose."""
    table = F.create_map(*[F.lit(x) for kv in SI_PREFIXES.items() for x in kv])
    value = F.ltrim(F.split_part(F.trim(text), F.lit("@"), F.lit(1)), F.lit(QUALIFIERS))

    def scaled(s: Column) -> Column:
        prefix, after = F.substring(s["rest"], 1, 1), F.substring(s["rest"], 2, 1)
        has_prefix = (F.length(s["rest"]) == 1) | ((after != "") & F.contains(F.lit(UNIT_SYMBOLS), after))
        return s["number"].cast("double") * F.when(has_prefix, F.coalesce(F.try_element_at(table, prefix), F.lit(1.0))).otherwise(1.0)

    def read(v: Column) -> Column:
        rest = lambda n: F.struct(n.alias("number"), F.ltrim(F.substring(v, F.length(n) + 1, F.length(v))).alias("rest"))
        return let(let(F.regexp_extract(v, NUMBER, 0), rest), lambda s: F.when(s["number"] != "", scaled(s)))

    return F.when(~F.contains(text, F.lit("~")), let(value, read))


def value_range(text: Column) -> tuple[Column, Column]:
    """Both magnitudes of ``low~high``, null unless both can be read."""
    low, high = magnitude(F.substring_index(text, "~", 1)), magnitude(F.substring(text, F.instr(text, "~") + 1, F.length(text)))
    both = F.contains(text, F.lit("~")) & low.isNotNull() & high.isNotNull()
    return F.when(both, low), F.when(both, high)


# Protocol tags and the patterns they are known by.
PROTOCOLS = {
    "RS-232": r"RS[\s-]?232", "RS-485": r"RS[\s-]?485", "I2C": "I2C", "SPI": "SPI", "UART": "UART", "USB": "USB",
    "CAN": "CAN", "LIN": "LIN", "Ethernet": "Ethernet", "HDMI": "HDMI", "LVDS": "LVDS", "PCIe": "PCIe",
}


def tags(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Names of the patterns of ``lexicon`` (protocols by default) found in a text, in its order."""
    found = [F.when(F.coalesce(text, F.lit("")).rlike(rf"(?iU)\b{p}\b"), F.lit(name)) for name, p in (lexicon or PROTOCOLS).items()]
    return F.array_compact(F.array(*found))


# Attribute name -> physical dimension -> SI symbol.
DIMENSION_SYMBOLS = {"resistance": "Ω", "capacitance": "F", "inductance": "H", "voltage": "V", "current": "A", "power": "W", "frequency": "Hz", "tolerance": "%"}
DIMENSIONS = {
    "resistance": ["resistance"], "capacitance": ["capacitance"], "inductance": ["inductance"], "power": ["power", "power dissipation"],
    "tolerance": ["tolerance"], "frequency": ["frequency", "clock frequency"], "current": ["current", "output current", "supply current", "standby current"],
    "voltage": ["voltage", "supply voltage", "output voltage", "input voltage", "operating voltage", "overload voltage", "maximum input voltage", "minimum input voltage", "max voltage", "min voltage"],
}


def unit(name: Column) -> Column:
    """SI symbol of what an attribute's name measures, null for names of no known dimension."""
    table = F.create_map(*[F.lit(x) for d, names in DIMENSIONS.items() for n in names for x in (n, DIMENSION_SYMBOLS[d])])
    return F.try_element_at(table, attr_name(name))


def stamp(at: Column) -> Column:
    """RFC 3339 text of a time, in seconds; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def link_status(url: Column, status: Column) -> Column:
    """struct(alive, http_status) of a check: 200 to 399 is alive; an address that may not be asked is
    dead with status 0, and so is one that did not answer."""
    code = F.when(checkable(url), F.coalesce(status, F.lit(0))).otherwise(0).cast("int")
    return F.struct(code.between(200, 399).alias("alive"), code.alias("http_status"))


def sparse(columns: list[str]) -> Column:
    """The named numeric columns as a map without nulls."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns])), lambda k, v: v.isNotNull())


EXTRA = "struct<mpn:string,attributes:map<string,variant>>"


def extra(raw: Column) -> Column:
    """struct(mpn, attributes) of an ``extra`` field; null if it is empty, no JSON or no object."""
    return F.when(F.json_object_keys(raw).isNotNull(), F.from_json(raw, EXTRA))


def corrupt(raw: Column) -> Column:
    """Whether an ``extra`` field says something that is no JSON object."""
    return F.coalesce((raw != "") & F.json_object_keys(raw).isNull(), F.lit(False))


def attribute_records(attributes: Column) -> Column:
    """array<struct(name, value_text)> of a map<string,variant>, in its order: a text is itself, an
    object stands for its ``primary``; payloads of other kinds are left out."""

    def record(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        text = F.when(kind == "STRING", F.try_variant_get(e["value"], "$", "string")).otherwise(F.try_variant_get(e["value"], "$.primary", "string"))
        return F.when((kind == "STRING") | kind.startswith("OBJECT"), F.struct(e["key"].alias("name"), text.alias("value_text")))

    return F.coalesce(F.array_compact(F.transform(F.map_entries(attributes), record)), F.array().cast("array<struct<name:string,value_text:string>>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a zero vector, null for different lengths or nulls."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) address, without brackets; empty for others."""
    named, literal = F.regexp_extract(url, r"^(?i)https?://([^/?#:@\[\]]+)", 1), F.regexp_extract(url, r"^(?i)https?://\[([0-9a-f:.]+)\](?:[:/?#]|$)", 1)
    return F.lower(F.when(literal != "", literal).otherwise(named))


def _public_ipv4(name: Column) -> Column:
    """Whether a dotted address is public; null for what is none."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    a, b, c, d = (F.split_part(name, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4))
    # Ranges that are not public.
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (c == 0) & (d != 9)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.when(name.rlike(rf"^{octet}(\.{octet}){{3}}$"), ~private)


def checkable(url: Column) -> Column:
    """http(s) addresses whose host is a dotted name with an alphabetic top level or a public
    address: a dotted one, or an IPv6 one in 2000::/3 that is not for documentation and neither
    maps nor tunnels a dotted one."""
    named = host(url)
    name = named.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)*\.[a-z]{2,}$")
    v6 = named.rlike(r"^[23][0-9a-f]{3}:[0-9a-f:]+$") & ~named.rlike(r"^(2001:0?db8|2001:0{0,3}:|2001::|2002|3fff):?")
    return F.coalesce(F.when(F.contains(named, F.lit(":")), v6).otherwise(F.coalesce(_public_ipv4(named), name)), F.lit(False))


def sane(new: Column, old: Column, most: float) -> Column:
    """``new`` if it is a finite number in [0, most], else ``old``."""
    return F.when(new.isNotNull() & ~F.isnan(new.cast("double")) & new.between(0, most), new).otherwise(old)


NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """The double that a plain decimal text stands for, else null."""
    text = F.trim(c)
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def tier_price(raw: Column) -> Column:
    """Unit price of a price field: a number, or the first number (or numeric text) under ``price``,
    ``Price`` or ``usd`` of the tiers of a JSON array; booleans and other texts are none."""
    tiers = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")

    def of(tier: Column) -> Column:
        def one(key: str) -> Column:
            v = F.try_variant_get(tier, f"$.{key}", "variant")
            return F.when(F.schema_of_variant(v) != "BOOLEAN", number(F.try_variant_get(v, "$", "string")))

        return F.coalesce(*map(one, ("price", "Price", "usd")))

    found = F.filter(F.transform(tiers, of), lambda p: p.isNotNull())
    return F.coalesce(number(raw), F.try_element_at(found, F.lit(1)))


# Unit symbol -> parameter, and letters that a package's name starts with.
SYMBOLS = {"Ω": "resistance", "ohm": "resistance", "F": "capacitance", "H": "inductance", "A": "current_max", "W": "power", "Hz": "frequency_max", "%": "tolerance_pct", "V": "voltage_max"}
PACKAGES = ("SOIC", "SOT", "SOD", "SON", "QFN", "DFN", "TQFP", "LQFP", "QFP", "TSSOP", "MSOP", "SSOP", "TSOP", "PDIP", "DIP", "SIP", "BGA", "LGA", "DPAK", "TO")
QUERY_CHARS, QUERY_TOKENS = 500, 10


def quantity(token: Column) -> Column:
    """struct(parameter, value) of a token such as ``10k``, ``100nF`` or ``1%``, else null. A prefix
    alone means ohms; a bare number, a range or a condition is no quantity."""
    shape = r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:([pnuµμmkKMGT])|[pnuµμmkKMGT]?(Hz|ohm|Ω|F|H|A|W|%|V))$"
    table = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    parameter = F.when(F.regexp_extract(token, shape, 1) != "", F.lit("resistance")).otherwise(F.try_element_at(table, F.regexp_extract(token, shape, 2)))
    return F.when(token.rlike(shape), F.struct(parameter.alias("parameter"), magnitude(token).alias("value")))


def package_code(token: Column) -> Column:
    """The upper-cased token if it names a package, else null."""
    upper = F.upper(token)
    return F.when(upper.rlike(r"^[0-9]{4}\z") | (upper.rlike(f"^({'|'.join(PACKAGES)})") & upper.rlike(r"^[A-Z0-9][A-Z0-9-]{0,19}\z")), upper)


def parse_query(raw: Column) -> Column:
    """struct(quantities, package, words) of a search text.

    Of the first ``QUERY_CHARS`` characters, each token is a quantity, the first package code, a
    word if it has a letter or digit, or nothing; reading stops after ``QUERY_TOKENS`` that are
    something. Null and blank texts give empty lists.
    """
    tokens = F.filter(F.split(F.substring(F.coalesce(raw, F.lit("")), 1, QUERY_CHARS), r"(?U)\s+"), lambda t: t != "")
    is_package = lambda t: quantity(t).isNull() & package_code(t).isNotNull()
    first = F.array_position(F.transform(tokens, is_package), True)
    kind = lambda t, i: F.when(quantity(t).isNotNull(), "quantity").when(i + 1 == first, "package").when(t.rlike("[A-Za-z0-9]"), "word")
    read = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), kind(t, i).alias("kind"))), lambda s: s["kind"].isNotNull())
    read = F.slice(read, 1, QUERY_TOKENS)
    of = lambda k, f: F.transform(F.filter(read, lambda s: s["kind"] == k), lambda s: f(s["t"]))
    return F.struct(of("quantity", quantity).alias("quantities"), F.try_element_at(of("package", package_code), F.lit(1)).alias("package"), of("word", lambda t: t).alias("words"))


def family(mpn_norm: Column) -> Column:
    """Leading letters of a part number if two or more, else its first three characters."""
    letters = F.regexp_extract(mpn_norm, "^[A-Z]{2,}", 0)
    return F.when(letters != "", letters).otherwise(F.substring(mpn_norm, 1, 3))


def embed_text(description: Column, category: Column, package: Column, tags: Column) -> Column:
    """The text that stands for a part; empty if it has tags alone."""
    base = F.filter(F.transform(F.array(description, category, package), lambda c: F.trim(c)), lambda c: c != "")
    named = F.array_sort(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != ""))
    return F.when(F.size(base) == 0, "").otherwise(F.concat_ws(" ", base, named))


#: English endings, step by step: (what the word looks like, what is kept and put in its place). In each
#: step the first that fits counts. They are the plural, -ed, -ing and -y steps of the English
#: Snowball stemmer, without its exceptions; a stem that the second step has cut is mended by the third.
PLURALS = (("^(.*ss)es$", "$1"), ("^(..+)ie[sd]$", "$1i"), ("^(.)ie[sd]$", "$1ie"), ("^(.*[us]s)$", "$1"), ("^(.*[aeiouy].+)s$", "$1"))
CUTS = (("^(.*[aeiouy][^aeiouy].*ee)d(ly)?$", "$1"), ("^(.*eed(ly)?)$", "$1"), ("^(.*[aeiouy].*)(ed|ing)(ly)?$", "$1"))
MENDS = (("^(.*(at|bl|iz))$", "$1e"), *((f"^(.*{c}){c}$", "$1") for c in "bdfgmnprt"), ("^([^aeiouy]*[aeiouy][^aeiouywx])$", "$1e"))
LAST = (("^(.+[^aeiouy])y$", "$1i"),)


def _step(word: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for pattern, kept in rules:
        test, made = F.regexp_like(word, F.lit(pattern)), F.regexp_replace(word, pattern, kept)
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(word)


def stem(word: Column) -> Column:
    """An English word without its plural, -ed, -ing or -ly; words of under three letters and those
    that have anything but a to z stay as they are."""
    cut = let(_step(word, PLURALS), lambda w: let(_step(w, CUTS), lambda c: F.when((c == w) | F.endswith(w, F.lit("eed")) | F.endswith(w, F.lit("eedly")), c).otherwise(_step(c, MENDS))))
    return F.when(F.regexp_like(word, F.lit("^[a-z]{3,}$")), let(cut, lambda w: _step(w, LAST))).otherwise(word)
