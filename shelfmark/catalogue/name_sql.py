"""SQL twins of the name rules, step by step in one nested query."""

from __future__ import annotations

_DASH = "\\s*-\\s*"


def normalized(source: str, raw: str, keep: str) -> str:
    """SELECT keep, name: the cleaned name of column ``raw`` in ``source``."""
    def step(inner: str, expression: str) -> str:
        return f"SELECT {keep}, {expression} AS n FROM ({inner})"

    def sub(pattern: str, to: str) -> str:
        return f"regexp_replace(n, '{pattern}', '{to}', 'g')"
    q = f"SELECT {keep}, replace(replace(coalesce({raw}, ''), chr(160), ' '), ',', '') AS n FROM ({source})"
    q = step(q, sub("[\\\\/]+", " - "))
    q = step(q, sub(f"(?:{_DASH}){{2,}}", " - "))
    q = step(q, sub("\\s+", " "))
    q = step(q, f"trim({sub(_DASH, ' - ')})")
    q = step(q, "array_to_string(list_transform(regexp_extract_all(n, "
                "'[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'), "
                "lambda w: (CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END) "
                "|| lower(substr(w, 2))), '')")
    q = step(q, sub("[<>:\"|?*]", ""))
    q = step(q, sub("\\s+", " "))
    q = step(q, f"rtrim(trim({sub(_DASH, ' - ')}), '-/')")
    q = (f"SELECT {keep}, n, rtrim(left(n, 80), ' -/') AS t FROM ({q})")
    q = (f"SELECT {keep}, CASE WHEN length(n) <= 80 THEN n WHEN substr(n, 81, 1) = ' ' THEN t "
         f"WHEN strpos(reverse(t), ' ') > 0 AND length(t) - strpos(reverse(t), ' ') > 0 "
         f"THEN rtrim(left(t, length(t) - strpos(reverse(t), ' ')), ' -/') ELSE t END AS n FROM ({q})")
    q = step(q, sub(f"(?:{_DASH}){{2,}}", " - "))
    q = step(q, sub("\\s+", " "))
    return f"SELECT {keep}, rtrim(trim(n), '-/') AS name FROM ({q})"


def safe(c: str) -> str:
    return f"trim(left(regexp_replace({c}, '[<>:\"/\\\\|?*]', '', 'g'), 80))"
