"""DuckDB SQL fragments mirroring ``quarry.functions`` (oracle side only)."""

from quarry.functions.paths import SPLITEXT_RX


def s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def posix(x):
    return f"replace({x}, '\\', '/')"


def basename(x):
    return f"string_split({posix(x)}, '/')[-1]"


def suffix(x):
    return f"regexp_extract({basename(x)}, {s(SPLITEXT_RX)}, 1)"


def parent(x):
    return f"CASE WHEN contains({posix(x)}, '/') THEN regexp_replace({posix(x)}, '/[^/]*$', '') ELSE '' END"


def depth(x):
    return f"CAST(len(string_split({posix(x)}, '/')) AS INTEGER)"


def normalize(x):
    p = posix(x)
    segs = (
        f"list_reduce(list_prepend('.', string_split({p}, '/')), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN "
        f"CASE WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] WHEN starts_with({p}, '/') THEN acc "
        f"ELSE list_append(acc, x) END ELSE list_append(acc, x) END, []::VARCHAR[])"
    )
    body = f"array_to_string({segs}, '/')"
    return f"(CASE WHEN starts_with({p}, '/') THEN '/' || {body} WHEN {body} = '' THEN '.' ELSE {body} END)"


def is_hidden(x):
    return f"list_bool_or(list_transform(string_split({posix(x)}, '/'), lambda c: starts_with(c, '.')))"


def tokens(x):
    return f"CAST(length({x}) // 4 AS BIGINT)"


def line_count(x):
    return f"CAST(length({x}) - length(replace({x}, chr(10), '')) + 1 AS BIGINT)"


def ends_any(x, exts):
    return "(" + " OR ".join(f"suffix({x}, {s(e)})" for e in dict.fromkeys(exts)) + ")"
