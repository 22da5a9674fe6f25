"""Column functions on note texts: tokens, stems, markup, summaries. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token class, accents and their plain letters.
TOKEN = r"[0-9a-zà-ÿ_-]{2,}"
ACCENTED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Plural endings rewritten in turn, then suffixes of which the first that leaves three letters goes.
PLURALS = (("coes", "cao"), ("soes", "sao"), ("oes", "ao"), ("aes", "ae"))
SUFFIXES = (
    "(?:idades|edades)", "(?:amente|mente)", "(?:coes|soes)", "(?:avel|ivel)", "(?:cao|sao)", "(?:ados|idas|idos|adas)",
    "(?:idade|edade)", "(?:inho|inha)", "(?:ado|ido|ada|ida)", "(?:ar|er|ir)", "s",
)
#: Words that are no proper nouns.
NOT_NOUNS = (
    "dr", "dra", "sr", "sra", "srta", "exmo", "exma", "ilmo", "ilma",
    "abc", "cep", "cnpj", "cpf", "edt", "gmt", "iso", "ltda", "me", "mei",
    "ong", "pdf", "rg", "rh", "sa", "sl", "sp", "rj", "usa", "utc", "url", "uti",
    "a", "as", "da", "das", "de", "do", "dos", "e", "em", "no", "na", "nos", "nas",
    "o", "os", "um", "uma", "uns", "umas", "para", "pelo", "pela",
)
#: Stop words of the plain word tokeniser.
STOP_WORDS = (
    "a", "o", "e", "de", "da", "do", "das", "dos", "na", "no", "nas", "nos",
    "em", "por", "para", "com", "sem", "que", "se", "as", "os", "um", "uma",
    "uns", "umas", "ao", "à", "às", "aos", "the", "of", "and", "to", "in",
)
#: Openings of questions, in Portuguese and English.
QUESTION_STARTS = (
    "o que", "como", "por que", "por quê", "quem", "quando", "onde",
    "qual", "quais", "quanto", "quantos", "quantas", "para que",
    "what", "how", "why", "who", "when", "where", "which",
)
#: Folders of quick captures, and header keys that name a source.
CAPTURE_FOLDERS = ("inbox", "capture", "fleeting", "scratch", "rascunho", "captura", "quick", "daily", "diário", "diario", "log", "notas-rápidas")
SOURCE_KEYS = ("source", "author", "authors", "url", "doi", "isbn", "journal", "book", "livro", "fonte", "autor", "artigo", "paper", "reference", "referência", "referencia")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


_HEADER = r"\A---\n[\s\S]*?\n---\n"
# A word boundary that knows ASCII word characters only.
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
WIKILINK = r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_words(text: Column) -> Column:
    """Words of two characters or more with a letter or digit, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def fold(text: Column) -> Column:
    """Lower case without accents; keeps every character's place."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def stem(token: Column) -> Column:
    """Light stemmer; null below two characters. Endings are compared, not searched for: the tokens are very many."""
    without = lambda t, n: F.substr(t, F.lit(1), F.length(t) - n)

    def plural(t: Column) -> Column:
        # A rewritten ending is none of the others, so the first that fits is the only one.
        fits = [(t.endswith(ending), F.concat(without(t, len(ending)), F.lit(single))) for ending, single in PLURALS]
        return F.when((F.length(t) >= 4) & (t.endswith("oes") | t.endswith("aes")), F.coalesce(*(F.when(a, b) for a, b in fits), t)).otherwise(t)

    def cut(t: Column) -> Column:
        size, found = F.length(t), []
        for suffix in SUFFIXES:
            # The longest of a group that fits, and no shorter one in its place.
            for ending in sorted(suffix.strip("(?:)").split("|"), key=len, reverse=True):
                longer = [x for x in suffix.strip("(?:)").split("|") if x.endswith(ending) and x != ending]
                fits = t.endswith(ending) & (size >= len(ending) + 3)
                for x in longer:
                    fits = fits & ~t.endswith(x)
                found.append(F.when(fits, without(t, len(ending))))
        # Most tokens end in none of the letters that the suffixes end in.
        return F.when(F.substr(t, F.lit(-1)).isin(*sorted({x[-1] for s in SUFFIXES for x in s.strip("(?:)").split("|")})), F.coalesce(*found, t)).otherwise(t)

    return let(fold(token), lambda t: F.when(F.length(t) >= 2, let(plural(t), cut)))


def stem_opening(stemmed: Column) -> Column:
    """What the folded form of every token with this stem begins with: suffixes are only cut off, and
    the rewritten plurals all end in ``ao`` instead of ``oes``."""
    return F.when(stemmed.endswith("ao"), F.substr(stemmed, F.lit(1), F.length(stemmed) - 2)).otherwise(stemmed)


def body_of(content: Column) -> Column:
    """Without the header block, leading blanks trimmed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), _HEADER, ""), r"\A\s+", "")


def header(content: Column) -> Column:
    """Header block as map<string, array<string>>: scalars, flow lists ``[a, b]`` and block lists ``- a``."""
    block = F.regexp_extract(F.coalesce(content, F.lit("")), r"\A---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    # One entry a key: its own line and the indented or dashed lines that follow.
    entries = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][^:\n]*:[^\n]*(?:\n[ \t]*-[ \t][^\n]*)*)"), F.lit(1))
    clean = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")

    def value(entry: Column) -> Column:
        def parsed(rest: Column) -> Column:
            flow = F.transform(F.split(F.regexp_extract(rest, r"^\[(.*)\]$", 1), ","), clean)
            dashed = F.transform(F.regexp_extract_all(entry, F.lit(r"(?m)^[ \t]*-[ \t]+([^\n]*)"), F.lit(1)), clean)
            found = F.when(rest.rlike(r"^\[.*\]$"), flow).when(rest == "", dashed).otherwise(F.array(clean(rest)))
            return F.filter(found, lambda x: x != "")

        return let(F.trim(F.regexp_extract(entry, r"^[^:\n]*:([^\n]*)", 1)), parsed)

    pairs = F.transform(entries, lambda e: F.struct(F.trim(F.regexp_extract(e, r"^([^:\n]*):", 1)).alias("key"), value(e).alias("value")))
    # Of a key's several entries the last counts.
    last = let(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last)


def as_list(values: Column) -> Column:
    """A list stays, a single comma-separated string is cut up."""
    return F.filter(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.transform(F.split(v, ","), lambda x: F.trim(x)))), lambda x: x != "")


def headings(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"(?m)^(#{1,6}\s+.+)$"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(h, r"^#+\s+", "")).alias("heading")))


def inline_tags(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(r"#[0-9A-Za-z_À-ſ\-]+"), F.lit(0)), lambda t: F.regexp_replace(t, "^#", ""))


def wikilinks(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def title_of(content: Column, path: Column) -> Column:
    h1 = F.filter(headings(body_of(content)), lambda h: h["level"] == 1)
    return F.coalesce(F.get(header(content)["title"], F.lit(0)), F.get(h1, F.lit(0))["heading"], stem_name(path))


def unique_folded(items: Column, least: int, most: int) -> Column:
    """Trimmed items of at least ``least`` characters, first of each lower-cased form, at most ``most``."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x) >= least)

    def first(both: Column) -> Column:
        lowered = F.transform(both, lambda x: x["low"])
        return let(lowered, lambda low: F.filter(both, lambda x, i: F.array_position(low, x["low"]) == i + 1))

    pairs = F.transform(kept, lambda x: F.struct(x.alias("own"), F.lower(x).alias("low")))
    return F.transform(F.slice(let(pairs, first), 1, most), lambda x: x["own"])


def proper_nouns(body: Column, most: int = 15) -> Column:
    """Capitalised words of 2 to 24 characters, not all capitals unless with a digit, no stop words."""
    found = F.regexp_extract_all(body, F.lit(_EDGE + r"[A-ZÀ-Ý][0-9A-Za-z_À-ÿ\-]{1,23}" + _EDGE), F.lit(0))
    stop = F.array(*map(F.lit, NOT_NOUNS))
    kept = F.filter(F.array_distinct(found), lambda w: ~F.array_contains(stop, F.lower(w)) & ((w != F.upper(w)) | w.rlike("[0-9]")))
    return unique_folded(kept, 2, most)


def acronyms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_EDGE + r"[A-Z]{2,}[A-Za-z0-9]*" + _EDGE), F.lit(0)))


def camel_case(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_EDGE + r"[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+" + _EDGE), F.lit(0)))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_name(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def domain_of(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    top = parts[0]
    clean = F.lower(F.regexp_replace(F.regexp_replace(top, r"^\d+[_\s-]*", ""), r"\s+", "-"))
    return F.when(path.isNull() | (path == ""), F.array(F.lit("unknown"))).when(F.size(parts) < 2, F.array(F.lit("root"))).otherwise(F.array(F.when(clean != "", clean).otherwise(top)))


def difficulty(chars: Column) -> Column:
    return F.when(chars > 10240, 4).when(chars > 5120, 3).when(chars > 2048, 2).otherwise(1)


def graded_difficulty(text: Column) -> Column:
    """1 to 5 from length, code fences, technical tokens and links; 1 below 500 characters."""
    technical = F.size(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z_])[A-Z]{3,}(?![0-9A-Za-z_])|\w+\(\)|@\w+"), F.lit(0))) > 5
    links = F.size(F.regexp_extract_all(text, F.lit(r"\[\[[^\]]+\]\]|\[[^\]]+\]\([^)]+\)"), F.lit(0))) > 3
    points = F.lit(1) + (F.length(text) >= 800).cast("int") + text.contains("```").cast("int") + technical.cast("int") + links.cast("int")
    return F.when(F.length(text) < 500, 1).otherwise(F.least(F.lit(5), points))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+(?=[A-ZÀ-Ý])")


def one_line_summary(body: Column, override: Column | None = None, most: int = 250) -> Column:
    """Override, else the first two sentences of prose lines, else the top heading and its first line."""
    prose = F.regexp_replace(F.trim(body), r"(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[^\n]*$|\z)", "")
    lines = F.filter(F.transform(F.split(prose, "\n"), lambda x: F.trim(x)), lambda t: (t != "") & ~t.rlike(r"^(?:#|- |\* |\d+\.\s|>|\|)"))
    # Lines are taken until those so far exceed one and a half summaries.
    taken = F.aggregate(lines, F.lit(""), lambda a, t: F.when(F.length(a) > most * 1.5, a).when(a == "", t).otherwise(F.concat(a, F.lit(" "), t)))
    found = F.substring(F.trim(F.array_join(F.slice(sentences(taken), 1, 2), " ")), 1, most)

    def fallback() -> Column:
        h1 = F.get(F.filter(headings(body), lambda h: h["level"] == 1), F.lit(0))["heading"]
        rest = F.get(F.filter(F.transform(F.split(F.regexp_replace(body, r"(?m)\A([\s\S]*?)^#+\s.*$", "$1"), "\n"), lambda x: F.trim(x)), lambda t: t != ""), F.lit(0))
        return F.coalesce(F.substring(F.concat(h1, F.lit(" — "), F.coalesce(rest, F.lit(""))), 1, most), F.lit(""))

    own = let(found, lambda x: F.when(x != "", x).otherwise(fallback()))
    return own if override is None else let(F.trim(override), lambda x: F.when(x != "", F.substring(x, 1, most)).otherwise(own))


def cue_of(heading: Column) -> Column:
    """A heading as a question for recall."""
    starts = "^(?:" + "|".join(QUESTION_STARTS) + ")"

    def asked(h: Column) -> Column:
        low = F.lower(h)
        with_mark = F.when(h.endswith("?"), h).otherwise(F.concat(h, F.lit("?")))
        return F.when(h.rlike("[?？]$"), h).when(low.rlike(starts) | (F.size(F.split(h, r"\s+")) > 6), with_mark).otherwise(F.concat(F.lit("O que é "), F.regexp_replace(low, "[?！!]", ""), F.lit("?")))

    return let(F.trim(heading), asked)


def cues(body: Column, concepts: Column, override: Column | None = None) -> Column:
    """Study cues: override, else up to eight second and third level headings, else three concepts."""
    second = F.regexp_extract_all(body, F.lit(r"(?m)^#{2,3}\s+(.+)$"), F.lit(1))
    named = F.filter(F.transform(second, lambda h: F.regexp_replace(F.trim(h), r"\*\*|__", "")), lambda h: F.length(h).between(3, 80))
    asked = F.filter(F.transform(F.slice(named, 1, 8), cue_of), lambda x: x != "")
    from_concepts = F.transform(F.slice(F.coalesce(concepts, F.array().cast("array<string>")), 1, 3), lambda c: F.concat(F.lit("O que é "), F.lower(c), F.lit("?")))
    own = let(asked, lambda x: F.when(F.size(x) > 0, x).otherwise(from_concepts))
    if override is None:
        return own
    given = F.filter(F.flatten(F.transform(F.coalesce(override, F.array().cast("array<string>")), lambda x: F.transform(F.split(x, r"[;,\n]+"), lambda x: F.trim(x)))), lambda x: x != "")
    return let(given, lambda x: F.when(F.size(x) > 0, x).otherwise(own))


def cue_summary(body: Column, summary: Column, override: Column | None = None) -> Column:
    opening = F.split(F.trim(F.regexp_replace(body, r"(?m)\A([\s\S]*?)^#{1,6}\s+.+\n?", "$1")), r"[.!?]\s")[0]
    cut = let(opening, lambda x: F.when(F.length(x) > 20, F.concat(F.trim(F.substring(x, 1, 200)), F.when(F.length(x) > 200, "…").otherwise(""))))
    own = F.coalesce(F.when(summary != "", summary), cut, F.lit(""))
    return own if override is None else F.when(F.trim(override) != "", F.trim(override)).otherwise(own)


def has_cue_layout(body: Column) -> Column:
    return body.rlike(r"(?i)#{2,3}\s*(perguntas[- ]chave|cue|questões|keywords)") | body.rlike(r"(?i)#{2,3}\s*(resumo|summary|síntese)")


def note_type(body: Column, path: Column, chars: Column, n_concepts: Column, fields: Column | None = None, override: Column | None = None) -> Column:
    """fleeting, literature, permanent or null; the order of the rules counts."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    capture = F.array(*map(F.lit, CAPTURE_FOLDERS))
    captured = F.coalesce(F.array_contains(capture, parts[0]), F.lit(False)) | F.coalesce(F.array_contains(capture, F.get(parts, F.lit(1))), F.lit(False))
    links = F.size(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))
    quoted = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^>\s"), F.lit(0))) / (F.length(body) - F.length(F.translate(body, "\n", "")) + 1)
    sourced = F.lit(False) if fields is None else F.exists(F.map_keys(fields), lambda k: F.lower(k).isin(*SOURCE_KEYS))
    own = (
        F.when((chars < 300) & (links == 0) & (captured | (chars < 150)), "fleeting")
        .when(F.coalesce(sourced, F.lit(False)) | (quoted > 0.3), "literature")
        .when((links >= 2) & (n_concepts >= 3) & (chars > 600), "permanent")
    )
    if override is None:
        return own
    given = F.lower(F.trim(override))
    return F.when(given.isin("fleeting", "literature", "permanent"), given).otherwise(own)


def note_id(at: Column, override: Column | None = None) -> Column:
    stamp = F.date_format(at, "yyyyMMddHHmm")
    return stamp if override is None else F.coalesce(F.when(F.trim(override) != "", F.trim(override)), stamp)


def atomic_splits(body: Column) -> Column:
    """Headings of second or third level whose section has over 200 non-blank characters, five at most."""
    sections = F.split(F.concat(F.lit("\n"), body), r"\n#{2,3}\s+")
    named = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{2,3}\s+(.+)$"), F.lit(1)), lambda x: F.trim(x))
    large = F.filter(named, lambda h, i: F.length(F.regexp_replace(F.coalesce(F.get(sections, i + 1), F.lit("")), r"\s", "")) > 200)
    return F.slice(large, 1, 5)


def excerpt(content: Column, query: Column, most: int = 220) -> Column:
    """Text around the query's first word, blanks collapsed, ellipses where it was cut."""

    def around(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - 40), F.least(F.length(content), at + most - 40)
        inner = F.trim(F.regexp_replace(F.substr(content, start + 1, end - start), r"\s+", " "))
        whole = F.concat(F.when(start > 0, "…").otherwise(""), inner, F.when(end < F.length(content), "…").otherwise(""))
        return F.when(at < 0, F.trim(F.regexp_replace(F.substring(content, 1, most), r"\s+", " "))).otherwise(whole)

    return let(F.instr(fold(content), F.split(fold(query), " ")[0]) - 1, around)


def trim_summary(text: Column, most: int = 300) -> Column:
    """At most ``most`` characters, cut after the last sentence end if that keeps over half."""
    t = F.trim(text)
    head = F.substring(t, 1, most)
    at = F.length(head) - F.least(*(F.when(F.instr(F.reverse(head), " " + mark) > 0, F.instr(F.reverse(head), " " + mark)).otherwise(most + 1) for mark in ".!?"))
    return F.when(F.length(t) <= most, t).when(at - 1 > most / 2, F.substr(head, F.lit(1), at)).otherwise(head)


def json_object(text: Column, schema: str) -> Column:
    """The outermost braces in a model's answer, parsed; null where that fails."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def one_place(x: Column) -> Column:
    """A double of 1 or more with one decimal, rounded by its exact binary value and ties to even, as C
    prints it (a format string rounds the shortest decimal form, and ties up)."""
    whole = F.floor(x)
    # The fraction is a multiple of 2^-52, so nothing is lost.
    ten = ((x - whole) * float(1 << 52)).cast("long") * 10
    tenth, rest = F.shiftright(ten, 52), ten.bitwiseAND((1 << 52) - 1)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (tenth % 2 == 1))
    return let(whole * 10 + tenth + up.cast("long"), lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))


def compact_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(one_place(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(one_place(n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


#: Patterns of the entity kinds (approximations of a system detector).
ENTITIES = (
    ("link", r"https?://[^\s<>\")]+"),
    ("phone", r"\+?\d[\d ().-]{7,}\d"),
    ("date", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"),
    ("address", r"\b\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln)\b|\b(?:Rua|Avenida|Praça) [A-Z][0-9A-Za-z ]{1,40}, \d{1,5}\b"),
)


def entity_kinds(text: Column) -> Column:
    """Links, phone numbers, dates and addresses by pattern."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.concat(*(found(kind, pattern) for kind, pattern in ENTITIES))


#: Frequent words that tell languages apart (an approximation of a system model).
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ich", "ein", "zu", "mit"),
    "en": ("the", "and", "of", "to", "is", "in", "that", "was", "for", "with"),
    "es": ("el", "los", "las", "que", "y", "en", "por", "con", "una", "del"),
    "fr": ("le", "les", "des", "et", "est", "dans", "une", "du", "pas", "pour"),
    "pt": ("os", "não", "uma", "em", "com", "para", "dos", "ao", "mais", "seu"),
}


def language_hypotheses(text: Column, most: int = 3) -> Column:
    """(lang, score) of the likeliest languages: a language's share of all frequent words found,
    best first, then by name; none without any such word."""

    def share(found: Column, lang: str) -> Column:
        return F.struct(F.size(F.filter(found, lambda w: w.isin(*LANGUAGE_WORDS[lang]))).alias("n"), F.lit(lang).alias("lang"))

    def ranked(found: Column) -> Column:
        counts = F.array(*(share(found, lang) for lang in LANGUAGE_WORDS))
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
        some = F.transform(F.filter(counts, lambda x: x["n"] > 0), lambda x: F.struct((-x["n"]).alias("n"), x["lang"].alias("lang")))
        return F.transform(F.slice(F.array_sort(some), 1, most), lambda x: F.struct(x["lang"].alias("lang"), F.round(-x["n"] / total, 6).alias("score")))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zà-ÿ]+"), F.lit(0)), ranked)


def image_text(name: Column, ocr: Column, labels: Column, faces: Column) -> Column:
    """A searchable text for an image from what was observed in it."""
    shown = F.array_join(F.transform(labels, lambda x: x["label"]), ", ")
    return F.concat_ws("\n", name, F.when(F.trim(ocr) != "", ocr), F.when(shown != "", F.concat(F.lit("labels: "), shown)), F.when(faces > 0, F.concat(F.lit("faces: "), faces.cast("string"))))
