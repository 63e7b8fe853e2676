"""SQL for DuckDB: the derived graphs and exact answers, written apart from the plans."""
from .plans.language import CONSTANT, Atom, Not, clauses, kind_of, parse
from .sources.graph import CODES, STAR

_KEY = {"c_custkey": "customer", "c_nationkey": "nation"}


def star() -> str:
    parts = []
    for r, name, (hk, hc), (tk, tc) in STAR:
        parts.append(f"SELECT {'DISTINCT ' if name == 'lineitem' else ''}({CODES[hk]}000000000 + {hc})::BIGINT AS h, {r}::BIGINT AS r, ({CODES[tk]}000000000 + {tc})::BIGINT AS t FROM {name}")
    forward = " UNION ALL ".join(parts)
    return f"(WITH fw AS ({forward}) SELECT * FROM fw UNION ALL SELECT t, xor(r, 1), h FROM fw)"


VECTOR = "(SELECT DISTINCT l_partkey % (SELECT count(*) FROM embeddings) AS h, (2 * (l_linenumber - 1))::BIGINT AS r, l_suppkey % (SELECT count(*) FROM embeddings) AS t FROM lineitem)"
VECTOR_BOTH = f"(SELECT h, r, t FROM {VECTOR} UNION ALL SELECT t, xor(r, 1), h FROM {VECTOR})"
VECTORS = "(SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS emb FROM embeddings)"


def exact(text: str, graph: str, instances: list[dict[str, int]]) -> str:
    """query_id, entity_id by EXISTS and NOT EXISTS, one statement per instance and clause."""
    parts = []
    for q, bind in enumerate(instances):
        for clause in clauses(parse(text)):
            positive = [x for x in clause if isinstance(x, Atom)]
            negative = [x.part for x in clause if isinstance(x, Not)]
            where, place = [], {}
            for i, a in enumerate(positive):
                where.append(f"k{i}.r = {bind[a.relation]}")
                for term, col in ((a.head, "h"), (a.tail, "t")):
                    if kind_of(term) == CONSTANT:
                        where.append(f"k{i}.{col} = {bind[term]}")
                    elif term in place:
                        where.append(f"k{i}.{col} = {place[term]}")
                    else:
                        place[term] = f"k{i}.{col}"
            for a in negative:
                end = lambda x: str(bind[x]) if kind_of(x) == CONSTANT else place[x]
                where.append(f"NOT EXISTS (SELECT 1 FROM kg n WHERE n.r = {bind[a.relation]} AND n.h = {end(a.head)} AND n.t = {end(a.tail)})")
            tables = ", ".join(f"kg k{i}" for i in range(len(positive)))
            parts.append(f"SELECT {q}::BIGINT AS query_id, {place['f']} AS entity_id FROM {tables} WHERE {' AND '.join(where)}")
    return f"WITH kg AS MATERIALIZED (SELECT * FROM {graph}) {' UNION '.join(f'(SELECT DISTINCT * FROM ({p}))' for p in parts)}"


def beam_steps(clause: list) -> dict[str, list[tuple[str, str, int, bool]]]:
    """Variable: (source, relation name, 1 for the inverse, negated) of the atoms that lead to it. Distances
    from f count steps between variables; an atom leads from the farther end, or a constant, to the nearer."""
    atoms = [(x, False) if isinstance(x, Atom) else (x.part, True) for x in sorted(clause, key=lambda x: isinstance(x, Not))]
    far, todo = {"f": 0}, ["f"]
    for v in todo:
        for a, _ in atoms:
            for x, y in ((a.head, a.tail), (a.tail, a.head)):
                if x == v and kind_of(y) != CONSTANT and y not in far:
                    far[y] = far[v] + 1
                    todo.append(y)
    out: dict[str, list] = {v: [] for v in far}
    for a, neg in atoms:
        for src, dst, inverse in ((a.head, a.tail, 0), (a.tail, a.head, 1)):
            if dst in far and (kind_of(src) == CONSTANT or far.get(src, -1) > far[dst]):
                out[dst].append((src, a.relation, inverse, neg))
    return out
