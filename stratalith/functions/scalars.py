"""Scalar functions as column expressions. What a function cannot parse is null unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_KIND, _REGULAR, _DIR = 0o170000, 0o100000, 0o040000
_LETTERS = ((0o100000, "-"), (0o040000, "d"), (0o020000, "c"), (0o060000, "b"), (0o010000, "p"), (0o120000, "l"), (0o140000, "s"))

#: Marks on stored names: a chunked file, a plain file whose name looks marked, a metadata list, a node of a split directory.
CHUNKED, PLAIN, METADATA, SPLIT = ".sl", ".sll", ".slm", ".sld"


def _cases(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out if default is None else out.otherwise(default)


_SIZE = r"^([\d.e+-]+)\s*(\w*)"


def human_size(size: Column) -> Column:
    """Bytes below 1024, otherwise one decimal (ties to the even digit) and a letter of KMGTPE (powers of 1024)."""
    out = F.when(size < 1024, size.cast("long").cast("string"))
    for i, letter in enumerate("KMGTPE", 1):
        part = F.concat(F.bround((size / F.lit(1024.0**i)).cast("decimal(38,18)"), 1).cast("decimal(20,1)").cast("string"), F.lit(letter))
        out = out.when(size < 1024.0 ** (i + 1), part) if i < 6 else out.otherwise(part)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of '1.5k', '2 gb', '1e+9 k': the longest numeric head, then a unit; truncated toward zero."""
    head, unit = F.regexp_extract(text, _SIZE, 1), F.lower(F.regexp_extract(text, _SIZE, 2))
    power = _cases([(unit.isin("", "b"), 0), (unit.isin("k", "kb"), 1), (unit.isin("m", "mb"), 2), (unit.isin("g", "gb"), 3), (unit.isin("t", "tb"), 4)])
    return (head.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long")


def parse_config_int(text: Column) -> Column:
    """An integer with k, m or g after it."""
    number, unit = F.regexp_extract(text, r"^\s*([-+]?\d+)([kKmMgG]?)$", 1), F.lower(F.regexp_extract(text, r"^\s*([-+]?\d+)([kKmMgG]?)$", 2))
    return number.try_cast("long") * _cases([(unit == "k", 1 << 10), (unit == "m", 1 << 20), (unit == "g", 1 << 30)], 1)


def parse_config_bool(text: Column) -> Column:
    """0, 1, true and false, and nothing else."""
    return F.when(text.isin("1", "true"), True).when(text.isin("0", "false"), False)


def parse_timestamp_ns(text: Column) -> Column:
    """Nanoseconds of '100ms', '3s'; the unit is required, a unit alone counts once."""
    pattern = r"^([-+]?[0-9]+)?(s|ms|us|ns)$"
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(number == "", 1).otherwise(number.try_cast("long")) * _cases([(unit == "s", 1_000_000_000), (unit == "ms", 1_000_000), (unit == "us", 1000), (unit == "ns", 1)])


def period_seconds(text: Column) -> Column:
    """Seconds of '3d', '2w' (months have 31 days, years 366); 'forever' is infinite."""
    pattern = r"^(\d+)([a-z]+)$"
    unit = F.regexp_extract(text, pattern, 2)
    scale = _cases([(unit == u, s) for u, s in (("s", 1), ("min", 60), ("h", 3600), ("d", 86400), ("w", 604800), ("m", 31 * 86400), ("y", 366 * 86400))])
    return F.when(text == "forever", F.lit(float("inf"))).otherwise(F.regexp_extract(text, pattern, 1).try_cast("double") * scale)


def mode_string(mode: Column) -> Column:
    """Ten characters in the manner of ls; set-id and sticky bits are not shown."""
    kind = mode.bitwiseAND(F.lit(_KIND))
    bits = [F.when(mode.bitwiseAND(F.lit(1 << (8 - i))) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(_cases([(kind == k, letter) for k, letter in _LETTERS], "?"), *bits)


def type_mark(mode: Column, executables: bool = True) -> Column:
    """The character that ls appends: / @ | = and, for executables, *."""
    kind = mode.bitwiseAND(F.lit(_KIND))
    pairs = [(kind == _DIR, "/"), (kind == 0o120000, "@"), (kind == 0o010000, "|"), (kind == 0o140000, "=")]
    if executables:
        pairs.insert(0, ((kind == _REGULAR) & (mode.bitwiseAND(F.lit(0o111)) != 0), "*"))
    return _cases(pairs, "")


def floor_seconds(ns: Column) -> Column:
    return F.floor((ns - F.pmod(ns, F.lit(1_000_000_000))) / 1_000_000_000).cast("long")


def seconds_text(ns: Column) -> Column:
    """Seconds with nine decimals where there are any; a negative time counts its seconds from the next whole one."""
    s, rest = floor_seconds(ns), F.pmod(ns, F.lit(1_000_000_000))
    s = F.when(s < 0, s + 1).otherwise(s)
    return F.when(rest == 0, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 9, "0")))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def path_prefixes(path: Column) -> Column:
    """Array of (name, full): the root, then every component of an absolute path with its full path."""
    parts = _segments(path)
    below = F.transform(parts, lambda p, i: F.struct(p.alias("name"), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")).alias("full")))
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.array(F.struct(F.lit("").alias("name"), F.lit("/").alias("full"))), below))


def clean_path(path: Column) -> Column:
    """An absolute path without empty and '.' components and without a last slash."""
    return F.concat(F.lit("/"), F.array_join(_segments(path), "/"))


def strip_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """The path without the longest prefix that it begins with as a string ('/a' is stripped from '/ab' too); '/' strips nothing."""
    clean = clean_path(path)
    out = clean
    for p in sorted({x.rstrip("/") for x in prefixes if x.rstrip("/")}, key=len):
        out = F.when(F.startswith(clean, F.lit(p)), F.substr(clean, F.lit(len(p) + 1))).otherwise(out)
    return out


def graft(path: Column, points: Sequence[tuple[str, str]]) -> Column:
    """The path with the first old prefix that matches replaced by its new one."""
    clean = clean_path(path)
    out = clean
    for old, new in reversed(points):
        old, new = (old.rstrip("/") or "/"), (new.rstrip("/") or "/")
        moved = F.regexp_replace(F.concat(F.lit(new), F.substr(clean, F.lit(len(old) + 1 if old != "/" else 1))), r"^/+", "/")
        out = F.when(F.startswith(clean, F.lit(old)), moved).otherwise(out)
    return out


def path_pieces(path: Column) -> Column:
    """Components that keep their slashes: '/a/b' is '/', 'a/', 'b'."""
    return F.regexp_extract_all(path, F.lit(r"([^/]*/|[^/]+$)"), 1)


def archive_path(path: Column) -> Column:
    """A relative path for an archive: what follows the last '/../', without '.', double and leading slashes; '.' if nothing is left."""
    p = F.regexp_replace(path, r"(?s)^.*/\.\./", "")
    p = F.regexp_replace(p, r"^\.\./", "")
    p = F.regexp_replace(p, r"/(\./)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^/+", ""), r"/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"/\.$", "")
    return F.when((p == "") | F.endswith(p, F.lit("/..")), ".").otherwise(p)


def extract_path(path: Column) -> Column:
    """Where an archive's path is extracted: without leading slashes, '.' for nothing, null where it would leave the target folder."""
    p = F.regexp_replace(path, "^/+", "")
    return F.when(p == "", ".").when(~risky_path(p), p)


def slash_append(path: Column) -> Column:
    """The path with a slash at its end, unless it is empty."""
    return F.when((path != "") & ~F.endswith(path, F.lit("/")), F.concat(path, F.lit("/"))).otherwise(path)


def restorable(path: Column) -> Column:
    """Whether a path names a save or something in it, and not only a branch."""
    absolute = F.startswith(path, F.lit("/"))
    stuck = lambda acc: (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
    up = lambda acc: F.when(stuck(acc), F.when(absolute, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
    parts = F.aggregate(_segments(path), F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    return F.size(parts) >= 2


def valid_repair_id(text: Column) -> Column:
    """Whether all characters are printable ASCII."""
    return text.rlike(r"^[\x20-\x7e]*\z")


def short_ids(text: Column) -> Column:
    """The text with each 40-digit id cut to 7 digits and a star."""
    return F.regexp_replace(text, r"([^0-9a-z]|\b)([0-9a-z]{7})[0-9a-z]{33}([^0-9a-z]|\b)", "$1$2*$3")


def parse_date(text: Column) -> Column:
    """Seconds as a number, null where the text is none."""
    return text.try_cast("double")


def zone_text(seconds: Column) -> Column:
    """'+0100' for seconds east of UTC."""
    minutes = F.floor(F.abs(seconds) / 60)
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def http_date(ns: Column) -> Column:
    """'Thu, 01 Jan 1970 00:00:00' of nanoseconds, where the session's zone is UTC."""
    return F.date_format(F.timestamp_seconds(floor_seconds(ns)), "EEE, dd MMM yyyy HH:mm:ss")


def same_file(a: str, b: str, columns: Sequence[str]) -> Column:
    """Whether two rows (aliases a and b) could be one file: all columns equal, nulls too."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def dot_path(path: Column) -> Column:
    """A relative path marked by '/./' so that it can follow a URL's host; others stay."""
    return F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/./"), path)).otherwise(path)


def _percent(text: Column, keep: str) -> Column:
    """Each byte but those of ASCII in `keep`, percent-encoded with lower-case digits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    plain = lambda h: F.decode(F.unhex(h), "UTF-8")
    one = lambda h: F.when((h < "80") & plain(h).rlike(f"^[{keep}]$"), plain(h)).otherwise(F.concat(F.lit("%"), F.lower(h)))
    return F.array_join(F.transform(pairs, one), "")


def render_url(scheme: Column, user: Column, host: Column, port: Column, path: Column, dots: bool = False) -> Column:
    """The URL of its parts (nulls and '' are left out). With a user, host or port a relative path is marked as dot_path does
    where dots is true, and otherwise makes null; without them '//' stands only before a path that begins so itself."""
    user, host, path = (F.coalesce(c, F.lit("")) for c in (user, host, path))
    name = r"\-._~0-9a-zA-Z!$&'()*+,;="
    mailed = F.when(user != "", F.concat(_percent(user, name + ":"), F.lit("@"))).otherwise("")
    front = F.concat(scheme, F.lit("://"), mailed, _percent(host, name), F.when(port.isNotNull() & (port != 0), F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    has_auth = (user != "") | (host != "") | port.isNotNull()
    fits = (path == "") | F.startswith(path, F.lit("/"))
    tail = dot_path(path) if dots else F.when(fits, path)
    return F.when(has_auth, F.concat(front, tail)).when(F.startswith(path, F.lit("//")), F.concat(front, path)).otherwise(F.concat(scheme, F.lit(":"), path))


def remote_parts(remote: Column) -> Column:
    """(user, host, path) of 'user@host:path', as remote repositories are named where no URL is; null without a colon or host,
    but host '-' stands for none."""
    user, rest = F.regexp_extract(remote, r"(?s)^(.*)@[^@]*$", 1), F.regexp_extract(remote, r"(?s)([^@]*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^:]*):", 1)
    parts = F.struct(F.when(host != "-", user).otherwise("").alias("user"), F.when(host != "-", host).otherwise("").alias("host"), F.regexp_extract(rest, r"(?s)^[^:]*:(.*)$", 1).alias("path"))
    return F.when(rest.contains(":") & (host != ""), parts)


_ESCAPES = {7: r"\a", 8: r"\b", 9: r"\t", 10: r"\n", 11: r"\v", 12: r"\f", 13: r"\r", 27: r"\e", 39: r"\'", 92: r"\\"}


def dollar_quote(text: Column) -> Column:
    """A word in the $'...' form of a POSIX shell; characters from 128 up stay as they are."""
    special = F.create_map(*(F.lit(x) for n in (*range(32), 39, 92, 127) for x in (chr(n), _ESCAPES.get(n, rf"\x{n:02x}"))))
    every = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda c: F.coalesce(F.try_element_at(special, c), c))
    return F.concat(F.lit("$'"), F.array_join(every, ""), F.lit("'"))


def terminal_text(text: Column) -> Column:
    """A path as a shell word that is safe to print: control characters make it $'...', blanks and the like '...'."""
    return (
        F.when(text.rlike(r"[\x00-\x1f\x7f]"), dollar_quote(text))
        .when(text.rlike(r"^[\p{L}\p{N}_./+:@%,=-]+\z"), text)
        .otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))
    )


def risky_path(path: Column) -> Column:
    """Whether extraction would leave the target folder."""
    return path.rlike(r"^/|/\.\./|^\.\./|/\.\.$")


def valid_ref_name(name: Column) -> Column:
    """Whether a save may have this name (a superset of the usual restrictions on reference names)."""
    bad = name.rlike(r"[\x00-\x20?*:^~\x7f\[\\]|@\{|/{2}|\.{2}") | name.rlike(r"^/|/$|\.$") | (name == "@") | name.rlike(r"(^|/)\.") | name.rlike(r"\.lock(/|$)")
    return ~bad


def mark_name(name: Column, mode: Column, stored_mode: Column) -> Column:
    """The stored name: a regular file stored as a tree is marked as chunked; a name that looks marked is marked as plain."""
    regular = lambda m: m.bitwiseAND(F.lit(_KIND)) == _REGULAR
    looks = F.endswith(name, F.lit(CHUNKED)) | F.endswith(F.substr(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(0))), F.lit(CHUNKED))
    return F.when(regular(mode) & ~regular(stored_mode), F.concat(name, F.lit(CHUNKED))).when(looks, F.concat(name, F.lit(PLAIN))).otherwise(name)


def unmark_name(name: Column, mode: Column) -> Column:
    """(name, chunked) of a stored name. A node of a split directory has no name of its own: null."""
    cut = lambda mark: F.substr(name, F.lit(1), F.length(name) - len(mark))
    is_dir = mode.bitwiseAND(F.lit(_KIND)) == _DIR
    plain = F.endswith(name, F.lit(PLAIN))
    return F.struct(
        F.when(plain, cut(PLAIN)).when(F.endswith(name, F.lit(CHUNKED)), cut(CHUNKED)).when(F.endswith(name, F.lit(METADATA)), cut(METADATA)).when(F.endswith(name, F.lit(SPLIT)), None).otherwise(name).alias("name"),
        F.when(plain, False).when(F.endswith(name, F.lit(CHUNKED)), True).when(F.endswith(name, F.lit(METADATA)), is_dir).otherwise(False).alias("chunked"),
    )


def split_depth(name: Column) -> Column:
    """Depth that the name of a split directory's top node tells; null for other names."""
    return F.regexp_extract(name, r"^.*\.([0-9]+)\.sld$", 1).try_cast("int")


def sql_identifier(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def sql_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def shell_quote(text: Column) -> Column:
    """A word for a POSIX shell: as it is where that is safe, otherwise in single quotes."""
    return F.when(text.rlike(r"^[a-zA-Z0-9_./-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def url_parts(url: Column) -> Column:
    """(scheme, user, host, port, path): the password is dropped, and a path that begins with '/./' is relative."""
    head = r"^([A-Za-z][A-Za-z\d.+-]*):(//)?(.*)$"
    slashes, rest = F.regexp_extract(url, head, 2) != "", F.regexp_extract(url, head, 3)
    auth = F.when(slashes, F.regexp_extract(rest, r"^([^/]*)", 1)).otherwise("")
    path = F.when(slashes, F.regexp_extract(rest, r"^[^/]*(.*)$", 1)).otherwise(rest)
    place = F.regexp_replace(auth, "^[^@]*@", "")
    return F.when(
        url.rlike(head),
        F.struct(
            F.regexp_extract(url, head, 1).alias("scheme"),
            F.url_decode(F.regexp_extract(auth, "^([^@:]*)[^@]*@", 1)).alias("user"),
            F.regexp_replace(place, r":\d*$", "").alias("host"),
            F.regexp_extract(place, r":(\d+)$", 1).try_cast("int").alias("port"),
            F.regexp_replace(path, r"^/\./+", "").alias("path"),
        ),
    )


def commit_text(tree: Column, parent: Column, author: Column, author_sec: Column, author_tz: Column, committer: Column, committer_sec: Column, committer_tz: Column, message: Column) -> Column:
    """The text of a commit; a null parent has no line. Zones are seconds east; minutes are floored first."""

    def when(sec: Column, tz: Column) -> Column:
        minutes = F.floor(tz / 60).cast("long")
        return F.concat(sec.cast("string"), F.when(minutes >= 0, " +").otherwise(" -"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("tree "), tree),
        F.concat(F.lit("parent "), parent),
        F.concat(F.lit("author "), author, F.lit(" "), when(author_sec, author_tz)),
        F.concat(F.lit("committer "), committer, F.lit(" "), when(committer_sec, committer_tz)),
        F.lit(""),
        message,
    )


def commit_fields(text: Column) -> Column:
    """What commit_text wrote, and signatures of other writers: tree, parents, names, mails, seconds, zone offsets, signature, message."""
    head = F.split_part(text, F.lit("\n\n"), F.lit(1))
    line = lambda who, g: F.regexp_extract(head, rf"(?m)^{who} (.*) <(.*)> (\d+) ([-+]\d{{4}})$", g)

    def offset(who: str) -> Column:
        z = line(who, 4)
        n = F.substring(z, 2, 2).try_cast("int") * 3600 + F.substring(z, 4, 2).try_cast("int") * 60
        return F.when(F.startswith(z, F.lit("-")), -n).otherwise(n)

    signature = F.regexp_extract(head, r"(?m)^gpgsig (.*(?:\n .*)*)", 1)
    return F.struct(
        F.regexp_extract(head, r"(?m)^tree ([0-9a-fA-F]{40})$", 1).alias("tree"),
        F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-fA-F]{40})$"), 1).alias("parents"),
        *(c for who in ("author", "committer") for c in (line(who, 1).alias(f"{who}_name"), line(who, 2).alias(f"{who}_mail"), line(who, 3).try_cast("long").alias(f"{who}_sec"), offset(who).alias(f"{who}_offset"))),
        F.when(signature != "", F.replace(signature, F.lit("\n "), F.lit("\n"))).alias("signature"),
        F.substr(text, F.instr(text, "\n\n") + 2).alias("message"),
    )


def has_trailers(message: Column) -> Column:
    """Whether the last line is a trailer: a key without blanks, a colon, anything."""
    last = F.element_at(F.split(F.regexp_replace(message, r"[\r\n]+$", ""), "\n"), -1)
    return last.rlike(r"^[^ \t]+:")


def bloom_rate(entries: Column, k: int, bits: Column) -> Column:
    """Percent of absent ids that a filter of 2**bits bytes with k slices reports as present."""
    return 100 * F.pow(1 - F.exp(-k * entries.cast("double") / (8 * F.pow(F.lit(2.0), bits))), F.lit(float(k)))
