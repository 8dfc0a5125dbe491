"""Pieces of oracle SQL. They restate the operators for DuckDB and share no code with them."""

from __future__ import annotations

W = 32  # words of a memory's states, 1024 bits
MASK = 4294967295


def item(name: str, words: int = W) -> str:
    return f"list_transform(range({words}), lambda w: ('0x' || substr(md5(lower({name}) || '#' || (w // 4)), 1 + 8 * (w % 4), 8))::BIGINT)"


def bind(a: str, b: str, words: int = W) -> str:
    return f"list_transform(range({words}), lambda i: xor(({a})[i + 1], ({b})[i + 1]))"


def rho(a: str, words: int = W) -> str:
    return f"list_transform(range({words}), lambda i: ((({a})[i + 1] << 1) | (({a})[(i + {words} - 1) % {words} + 1] >> 31)) & {MASK})"


def ham(a: str, b: str, words: int = W) -> str:
    return f"list_sum(list_transform(range({words}), lambda i: bit_count(xor(({a})[i + 1], ({b})[i + 1]))))::INT"


#: Memories of up to 32 documents' facts.
FACTS = """f AS (SELECT doc_id // 32 AS mem, fact_id AS ord, s, r, o, coalesce(weight, 1)::BIGINT AS n FROM facts
 WHERE doc_id IS NOT NULL AND s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL)"""
BOOK = """book AS (SELECT mem, name, min(pos) AS idx FROM (SELECT mem, s AS name, ord * 3 AS pos FROM f UNION ALL
 SELECT mem, r, ord * 3 + 1 FROM f UNION ALL SELECT mem, o, ord * 3 + 2 FROM f) GROUP BY mem, name)"""
#: States of every name that occurs, kept apart so that each is computed once.
HV = f"""hv AS MATERIALIZED (SELECT name, {item('name')} AS v FROM (SELECT DISTINCT name FROM book)),
 rv AS MATERIALIZED (SELECT name, {rho('v')} AS v FROM hv)"""
STATE = f"""st AS MATERIALIZED (SELECT f.mem, f.ord, f.n, f.s, f.r, f.o, {bind('a.v', 'b.v')} AS k, c.v AS ov FROM f
 JOIN hv a ON a.name = f.s JOIN rv b ON b.name = f.r JOIN hv c ON c.name = f.o)"""


def majority(src: str, key: str, state: str, words: int = W, tie: str = "item") -> str:
    """(key, n, trace) of the weighted majority of ``state`` in ``src`` (key, n, state)."""
    bits = ", ".join(f"sum(n * ((v >> {b}) & 1)) AS b{b}" for b in range(32))
    tied = {"item": f"({item(chr(39) + '__tie__' + chr(39), words)})[w + 1]", "plus": "0", "minus": str(MASK)}[tie]
    word = " + ".join(f"CASE WHEN 2 * b{b} > alln OR (2 * b{b} = alln AND ((tw >> {b}) & 1) = 1) THEN {1 << b}::BIGINT ELSE 0 END" for b in range(32))
    return f"""(SELECT {key}, max(alln) AS n, list(word ORDER BY w) AS trace FROM (SELECT {key}, w, alln, ({word})::BIGINT AS word FROM
 (SELECT *, {tied} AS tw FROM (SELECT {key}, w, sum(n) AS alln, {bits} FROM
  (SELECT {key}, n, unnest({state}) AS v, unnest(range({words})) AS w FROM {src}) GROUP BY {key}, w))) GROUP BY {key})"""


TRACE = f"tr AS MATERIALIZED (SELECT mem, n, trace FROM {majority('(SELECT mem, n, ' + bind('k', 'ov') + ' AS state FROM st)', 'mem', 'state')})"
MEMORY = f"{FACTS}, {BOOK}, {HV}, {STATE}, {TRACE}"


def cleanup(noisy: str, query: str, where: str = "TRUE") -> str:
    """(mem, query.., answer, dist): nearest name of the memory for ``noisy`` (mem, query.., noisy)."""
    return f"""(SELECT mem, {query}, answer, dist FROM (SELECT q.mem, {query}, book.name AS answer, {ham('q.noisy', 'hv.v')} AS dist,
 row_number() OVER (PARTITION BY q.mem, {query} ORDER BY {ham('q.noisy', 'hv.v')}, book.idx) AS rn
 FROM {noisy} q JOIN book ON book.mem = q.mem JOIN hv ON hv.name = book.name WHERE {where}) WHERE rn = 1)"""
