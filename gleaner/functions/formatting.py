"""Metadata parsing and display formats as Spark SQL expressions; each takes and gives an expression string."""

from __future__ import annotations

from gleaner.functions.text import literal


def channel_ref(url: str) -> str:
    """struct(type, id) of a channel address, null if it names none. ``www.`` and ``m.`` go at the host's start only."""
    full = f"IF({url} RLIKE '^https?://', {url}, concat('https://', {url}))"
    u = f"regexp_replace({full}, {literal(r'^(https?://)(?:www\.|m\.)+')}, '$1')"
    forms = (("handle", "/@"), ("channel_id", "/channel/"), ("user", "/user/"), ("c", "/c/"))
    cases = " ".join(f"WHEN {u} RLIKE {literal(f'{mark}[^/?]+')} THEN named_struct('type', '{kind}', 'id', regexp_extract({u}, {literal(f'{mark}([^/?]+)')}, 1))" for kind, mark in forms)
    return f"CASE {cases} END"


def iso_duration(s: str) -> str:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds; 0 if empty or not one."""
    part = lambda unit: f"CAST(coalesce(nullif(regexp_extract({s}, {literal(rf'(\d+){unit}')}, 1), ''), '0') AS BIGINT)"
    form = literal(r"^P(?=.)(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$")
    return f"IF(coalesce({s}, '') RLIKE {form}, {part('D')} * 86400 + {part('H')} * 3600 + {part('M')} * 60 + {part('S')}, 0L)"


def iso_date(s: str) -> str:
    """The date as written, in its own offset; 'unknown' if there is no valid time."""
    return f"IF(try_to_timestamp({s}) IS NULL, 'unknown', left({s}, 10))"


def safe_int(s: str) -> str:
    return f"coalesce(TRY_CAST({s} AS BIGINT), 0L)"


def clock(seconds: str) -> str:
    """M:SS, or H:MM:SS from an hour on; under zero counts as zero."""
    x = f"greatest(CAST({seconds} AS BIGINT), 0L)"
    return f"IF({x} >= 3600, format_string('%d:%02d:%02d', {x} div 3600, ({x} % 3600) div 60, {x} % 60), format_string('%d:%02d', {x} div 60, {x} % 60))"


def _tenth(n: str, unit: int) -> str:
    """n / unit with one decimal, ties to even as binary floating point has them: tenths are counted in whole numbers."""
    twice = f"({n} * 20)"  # n / unit in twentieths
    q, r = f"({twice} div {unit})", f"({twice} % {unit})"
    tenths = f"IF({q} % 2 = 1 AND {r} = 0, IF((({q} - 1) div 2) % 2 = 0, ({q} - 1) div 2, ({q} + 1) div 2), ({q} + 1) div 2)"
    return f"concat({tenths} div 10, '.', {tenths} % 10)"


def view_count(n: str) -> str:
    million, thousand = 1_000_000, 1_000
    part = lambda unit, mark: f"IF({n} % {unit} = 0, concat({n} div {unit}, '{mark} views'), concat({_float_tenth(n, unit)}, '{mark} views'))"
    return f"CASE WHEN {n} >= {million} THEN {part(million, 'M')} WHEN {n} >= {thousand} THEN {part(thousand, 'K')} WHEN {n} = 1 THEN '1 view' ELSE concat({n}, ' views') END"


def _float_tenth(n: str, unit: int) -> str:
    """One decimal of the double n / unit (1 or more), rounded by its exact binary value, ties to even.

    The fraction times 2**53 is a whole number, so it is compared with the middle of two tenths without error.
    """
    one = 1 << 53
    x = f"(CAST({n} AS DOUBLE) / {unit})"
    f = f"CAST(({x} - floor({x})) * {float(one)!r}D AS BIGINT)"
    k = f"({f} * 10L div {one}L)"
    low, over = f"(CAST(floor({x}) AS BIGINT) * 10 + {k})", f"({f} * 20L - (2 * {k} + 1) * {one}L)"
    tenths = f"({low} + IF({over} > 0 OR {over} = 0 AND {low} % 2 = 1, 1, 0))"
    return f"concat({tenths} div 10, '.', {tenths} % 10)"


def file_size(n: str) -> str:
    """Steps of 1,024 from B to TB, one decimal but for B."""
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = [f"WHEN {n} < 1024 THEN concat({n}, ' B')"]
    for k in range(1, 5):
        top = f"{n} < {1024 ** (k + 1)}L" if k < 4 else "TRUE"
        cases.append(f"WHEN {top} THEN concat({_tenth(f'CAST({n} AS BIGINT)', 1024**k)}, ' {units[k]}')")
    return f"CASE {' '.join(cases)} END"


def thousands(n: str) -> str:
    return f"format_number({n}, 0)"


def human_duration(seconds: str) -> str:
    h, m = f"({seconds} div 3600)", f"(({seconds} % 3600) div 60)"
    hours = f"concat({h}, ' hour', IF({h} = 1, '', 's'))"
    return f"CASE WHEN {seconds} < 60 THEN concat({seconds}, ' seconds') WHEN {seconds} < 3600 THEN concat({seconds} div 60, ' minutes') WHEN {m} > 0 THEN concat({hours}, ' ', {m}, ' minutes') ELSE {hours} END"


def sanitize_filename(s: str) -> str:
    return f"trim(BOTH ' .' FROM regexp_replace(regexp_replace({s}, {literal(chr(91) + '<>:' + chr(34) + '/' + chr(92) * 2 + '|?*' + chr(93))}, ''), {literal(r'(?U)\s+')}, ' '))"


def generate_filename(title: str) -> str:
    return f"concat(regexp_replace(regexp_replace(coalesce({title}, 'untitled'), {literal(r'(?U)[^\w\s-]')}, ''), {literal(r'(?U)[-\s]+')}, '-'), '.md')"


def display_line(title: str, seconds: str, date: str, views: str, status: str = "''", max_title: int = 60) -> str:
    """Title cut to what 80 characters leave, then length, date and views; status 'new' and 'extracted' have a sign in front."""
    sign = f"CASE {status} WHEN 'new' THEN '\U0001f195 ' WHEN 'extracted' THEN '✅ ' ELSE '' END"
    suffix = f"concat(' (', {clock(seconds)}, ') - ', coalesce(nullif({date}, ''), 'Unknown'), ' - ', {view_count(views)})"
    room = f"least({max_title}, 80 - length(concat({sign}, {suffix})))"
    return f"concat({sign}, IF(length({title}) > {room}, concat(left({title}, greatest({room} - 3, 0)), '...'), {title}), {suffix})"


def cache_key(endpoint: str, params: str) -> str:
    """md5 of the endpoint and the sorted, encoded parameters; ``params`` is a map of strings."""
    pairs = f"transform(array_sort(map_entries({params})), e -> concat(url_encode(e.key), '=', url_encode(e.value)))"
    return f"md5(concat({endpoint}, ':', array_join({pairs}, '&')))"


def strip_fence(s: str) -> str:
    """Text of a fenced block without its first line and last fence; other text trimmed."""
    t = f"regexp_replace({s}, {literal(r'(?U)^\s+|\s+$')}, '')"
    return f"IF({t} LIKE '```%', regexp_replace(regexp_replace({t}, {literal(r'(?s)^```[^\n]*\n(.*?)(?:```(?:(?!```).)*)?$')}, '$1'), {literal(r'(?U)^\s+|\s+$')}, ''), {t})"


def valid_id(s: str) -> str:
    return f"{s} RLIKE {literal(r'^[a-z0-9]+(-[a-z0-9]+)+$')}"


# Fixed value: the kinds that may begin a reference.
REFERENCE_KINDS = "technique|pattern|use-case|capability|integration|antipattern|component|issue|config|snippet"


def cross_references(content: str, own: str) -> str:
    pattern = literal(rf"(?i)\b({REFERENCE_KINDS})-[a-z0-9-]+\b")
    return f"array_sort(array_remove(array_distinct(regexp_extract_all({content}, {pattern}, 0)), {own}))"


def truncated(s: str, cap: int = 350) -> str:
    return f"left({s}, {cap})"


def percent(done: str, total: str) -> str:
    return f"IF({total} = 0, 100.0D, {done} * 100.0D / {total})"


def rate_per_minute(done: str, seconds: str) -> str:
    return f"IF({seconds} <= 0, 0.0D, {done} * 60.0D / {seconds})"


def seconds_left(left: str, per_minute: str) -> str:
    return f"IF({per_minute} <= 0, 0.0D, {left} * 60.0D / {per_minute})"


def retryable(status: str, message: str) -> str:
    """Server errors and rate limits, or a message that names a passing fault."""
    # Fixed value: the words.
    words = literal("timeout|connection|rate limit|server error|service unavailable|internal error")
    return f"coalesce({status} >= 500 OR {status} = 429, lower({message}) RLIKE {words}, false)"
