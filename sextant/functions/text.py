"""Scalar text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with", "what", "where", "which", "who", "whom", "whose", "why", "how", "when", "do", "does", "did", "can", "could", "i", "we",
    "you", "my", "our", "your", "from", "has", "have", "had", "should", "would",
)

IDENTIFIER = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(word: Column | str) -> Column:
    """A plural's singular: only ASCII words of three letters or more that end in s change."""
    w = col(word)
    return (
        F.when(~F.endswith(w, F.lit("s")), w)
        .when(~w.rlike(r"^[\x00-\x7F]{3,}$") | w.rlike("(us|ss)$"), w)
        .when(w.rlike("[^ae]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("[iaoe]es$"), w)
        .otherwise(F.regexp_replace(w, "s$", ""))
    )


def parts(identifier: Column | str) -> Column:
    """Lower-case parts of an identifier: cut at underscores and where the case changes."""
    cut = F.regexp_replace(col(identifier), r"([\p{Ll}\p{N}])(\p{Lu})", "$1_$2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    # Most words are one part, as one look tells.
    single = ~col(identifier).rlike(r"_|.\p{Lu}")
    return F.when(single, F.array(F.lower(col(identifier)))).otherwise(F.filter(F.split(F.lower(cut), "_"), lambda x: x != ""))


def words(text: Column | str) -> Column:
    """Search words of a text: the stemmed parts of each identifier, and of one with several
    parts also the stem of all of them together. Null gives none."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    each = F.transform(F.transform(found, parts), lambda p: F.when(F.size(p) > 1, F.concat(F.transform(p, stem), F.array(stem(F.array_join(p, ""))))).otherwise(F.transform(p, stem)))
    return F.flatten(each)


def identifiers(text: Column | str) -> Column:
    """The identifiers of a text, in order; null gives none. Each has words of its own, so equal ones may be counted first."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def cut_lower(text: Column | str) -> Column:
    """A text in lower case whose identifiers have an underscore where `parts` cuts them."""
    whole = F.coalesce(col(text), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(whole, r"([\p{Ll}\p{N}])(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    # Most texts have no place to cut, as one look tells.
    return F.lower(F.when(whole.rlike(r"[\p{L}\p{N}]\p{Lu}"), cut).otherwise(whole))


def word_count(cut: Column) -> Column:
    """How many `words` a text has, of what `cut_lower` made of it: its parts, and one more for each identifier of several."""
    several = F.regexp_count(cut, F.lit(r"[\p{L}\p{N}]++_++[\p{L}\p{N}][\p{L}\p{N}_]*+"))
    return F.regexp_count(cut, F.lit(r"[\p{L}\p{N}]++")) + F.when(cut.contains("_"), several).otherwise(0)


def word_times(cut: Column, word: str) -> Column:
    """How often `words` of a text hold a stemmed word, of what `cut_lower` made of it, by plain searches:
    the parts that have its stem, and the identifiers of several parts that do when written together."""
    forms = [w for w in {word, f"{word}s", f"{word[:-1]}ies"} if w and stemmed(w) == word]
    if not forms:
        return F.lit(0)
    inner, outer = r"[\p{L}\p{N}]", r"[\p{L}\p{N}_]"
    plain = "|".join(re.escape(w) for w in sorted(forms))
    spread = "|".join("_*+".join(re.escape(c) for c in w) for w in sorted(forms))
    parts_ = F.regexp_count(cut, F.lit(f"(?<!{inner})(?:{plain})(?!{inner})"))
    whole = F.regexp_count(cut, F.lit(f"(?<!{outer})_*+(?:{spread})_*+(?!{outer})"))
    alone = F.regexp_count(cut, F.lit(f"(?<!{outer})_*+(?:{plain})_*+(?!{outer})"))
    held = reduce(lambda a, b: a | b, (cut.contains(w) for w in forms))
    return F.when(held, parts_).otherwise(0) + F.when(cut.contains("_"), whole - alone).otherwise(0)


def is_stop(word: Column | str) -> Column:
    """Whether a stemmed word is a stop word's stem."""
    return col(word).isin(*sorted({stemmed(w) for w in STOP_WORDS}))


def stemmed(word: str) -> str:
    """`stem` of a plain string, for words the driver holds."""
    if len(word) < 3 or not word.isascii() or not word.endswith("s") or word.endswith(("us", "ss")):
        return word
    if word.endswith("ies") and len(word) > 3 and word[-4] not in "ae":
        return word[:-3] + "y"
    if word.endswith(("ies", "aes", "oes", "ees")):
        return word
    return word[:-1]


def slug(heading: Column | str) -> Column:
    """Anchor of a heading: lower case, letters, marks, digits, connectors and hyphens stay, spaces become hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(heading)), r"[^\p{L}\p{M}\p{Nd}\p{Pc}\- ]", ""), " ", "-")


def numbered_slug(base: Column | str, nth: Column | str) -> Column:
    """`base` for the first heading of a slug (nth 0), `base-nth` for the others."""
    return F.when(col(nth) == 0, col(base)).otherwise(F.concat_ws("-", col(base), col(nth).cast("string")))


def first_sentence(doc: Column | str, most: int = 200) -> Column:
    """First sentence of the first paragraph, cut to `most` characters and an ellipsis; null if there is none.

    Lines are trimmed and joined by spaces; a sentence ends at `. ` after a character that is no space.
    """
    lines = F.transform(F.split(col(doc), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    paragraph = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"^\n+", ""), "\n\n", 2)[0]
    flat = F.regexp_replace(F.regexp_replace(paragraph, r"\n$", ""), "\n", " ")
    sentence = F.regexp_extract(flat, r"^(.*?\S\.) ", 1)
    whole = F.when(sentence == "", flat).otherwise(sentence)
    return F.when(whole == "", F.lit(None)).when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("…"))).otherwise(whole)


def capped(text: Column | str, most: int = 200) -> Column:
    return F.substring(col(text), 1, most)


def span(start: Column | str, end: Column | str) -> Column:
    """`12`, or `12-20`."""
    return F.when(col(start) == col(end), col(start).cast("string")).otherwise(F.concat_ws("-", col(start).cast("string"), col(end).cast("string")))


def counted(n: Column | str, word: str) -> Column:
    """`1 caller`, `2 callers`."""
    return F.concat(col(n).cast("string"), F.lit(f" {word}"), F.when(col(n) == 1, F.lit("")).otherwise(F.lit("s")))


def last_segment(path: Column | str) -> Column:
    """Last segment of a `::` or `.` path."""
    return F.element_at(F.split(col(path), r"::|\."), -1)


def suffix_matches(name: Column | str, wanted: list[str]) -> Column:
    """Whether the segments of a name end in those wanted; `#n` after a segment of the name is passed over."""
    found = F.transform(F.split(col(name), r"::|\."), lambda s: F.regexp_replace(s, r"#\d+$", ""))
    n = len(wanted)
    return (F.size(found) >= n) & (F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), n) == F.array(*[F.lit(w) for w in wanted]))


def through(path: Column | str, names: list[str]) -> Column:
    """Whether a path has one of the names among its segments."""
    return F.arrays_overlap(F.split(col(path), r"::|\."), F.array(*[F.lit(n) for n in names]))


def path_like(text: Column | str, extensions: tuple[str, ...] = ("rs", "nix", "sh", "bash", "py", "c", "h", "md")) -> Column:
    return col(text).contains("/") | col(text).rlike(rf"\.({'|'.join(extensions)})$")


def test_file(path: Column | str) -> Column:
    """Test code, by a folder of tests or by the file's name up to its first dot."""
    name = F.regexp_extract(col(path), r"([^/.]*)[^/]*$", 1)
    return col(path).rlike("(^|/)(tests|test|__tests__)/") | name.isin("conftest", "tests", "test") | name.rlike("^test[_-]") | name.rlike("([_-]test|_tests)$")


def module_name(path: Column | str) -> Column:
    """Python module of a file."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(path), r"\.pyi?$", ""), r"(^|/)__init__$", ""), "/", ".")


def decoded(text: Column | str) -> Column:
    """Percent-decoded text; a plus sign stays one."""
    return F.try_url_decode(F.regexp_replace(col(text), r"\+", "%2B"))


def relative_link(destination: Column | str) -> Column:
    """A link's path and fragment if it leads into the worktree, else null."""
    d = F.trim(col(destination))
    outside = d.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | d.startswith("//") | d.isin("", "#")
    return F.when(~outside, F.regexp_replace(d, r"^([^#?]*)\?[^#]*", "$1"))


def ids(html: Column | str) -> Column:
    """Element ids and names of anchors."""
    one = F.regexp_extract_all(col(html), F.lit(r"(?i)<[a-z][^>]*?\sid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    two = F.regexp_extract_all(col(html), F.lit(r"(?i)<a\s[^>]*?name\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.concat(one, two))


def folded(path: Column | str, base: Column | str) -> Column:
    """A relative path from the folder of file `base`, `.` and `..` folded; null if it leaves the root."""
    at = F.split(col(base), "/")
    whole = F.when(col(path).startswith("/"), F.split(F.substring(col(path), 2, 1 << 20), "/")).otherwise(F.concat(F.slice(at, 1, F.size(at) - 1), F.split(col(path), "/")))
    out = F.aggregate(
        F.filter(whole, lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.concat(done, F.array(s)))
        .when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.when(~F.array_contains(out, ".."), F.array_join(out, "/"))


def in_list(value: Column | str, wanted: Column | str) -> Column:
    """Membership in a list parted by commas and white space."""
    return F.array_contains(F.split(F.trim(col(value)), r"[,\s]+"), col(wanted))


def civil_date(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd")


def short(sha: Column | str, n: int = 9) -> Column:
    return F.substring(col(sha), 1, n)


def blob_id(text: Column | str) -> Column:
    """Git's id of a blob holding the text, or the binary value."""
    data = F.encode(col(text), "UTF-8") if isinstance(text, str) else col(text)
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.lit("\0")), "UTF-8")
    return F.sha1(F.concat(head, data))


def language_of(path: Column | str, head: Column | None = None) -> Column:
    """Language of a file by its extension as it is written; of one without any, by the program its
    first line names, else by what a shell script says of itself at its top."""
    name = F.element_at(F.split(col(path), "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    by_name = reduce(
        lambda w, kv: w.when(ext.isin(*kv[1]), F.lit(kv[0])),
        [("nix", ("nix",)), ("bash", ("sh", "bash")), ("python", ("py",)), ("c", ("c", "h")), ("markdown", ("md", "markdown"))],
        F.when(ext == "rs", F.lit("rust")),
    )
    if head is None:
        return by_name
    # `env` and its options and settings, and the folders of a program, are passed over.
    program = F.regexp_extract(head, r"\A#!\s*(?:\S*/)?(?:env(?:\s+(?:(?:-u|--unset|-C|--chdir)\s+\S+|-\S+|[^\s=]*=\S*))*\s+)?(\S+)", 1)
    program = F.element_at(F.split(program, "/"), -1)
    run = F.when(program.isin("bash", "sh"), F.lit("bash")).when(program.rlike(r"\A(python|python3(\.[0-9]+)?)\z"), F.lit("python"))
    mode = head.rlike(r"(?i)\A\s*[^\n]*?-\*-\s*(?:(?:[^\n]*;)?\s*mode:\s*)?(sh|shell-script|bash)\s*(;[^\n]*)?-\*-")
    # A directive stands above the first command, among comments and blank lines.
    directive = head.rlike(r"\A(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*#\s*shellcheck\s+(?:[^\n]*\s)?shell=(bash|sh)\b")
    said = F.when(~head.startswith("#!") & (mode | directive), F.lit("bash"))
    return F.when(name.contains("."), by_name).otherwise(F.coalesce(run, said))
