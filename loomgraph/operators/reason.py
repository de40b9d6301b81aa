"""Reasoning over triples (s, p, o) of text columns: RDFS, an OWL 2 RL subset, own rules.

Rules are joins of patterns.  Derivation is semi-naive: in every round each rule
runs once for each of its body patterns, with that pattern over the last round's
new triples only, so a derivation is looked at once.  Rounds are tables in the
shared folder; the loop ends when a round adds nothing.  With ``explain`` the
rule that first gave a triple is kept beside it.

``rdfs_on_read`` derives nothing: it closes the schema (which is small; its size
is checked before it is broadcast) and joins it with data as it is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lanes import RDF
from .tables import Rounds

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
#: Rows of a closed schema that may be broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[tuple[str, str, str], ...]


_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}


def rule(name: str, text: str, prefixes: dict[str, str] | None = None) -> Rule:
    """``(?a p ?b) (?b p ?c) -> (?a p ?c)`` as a rule; names with a prefix are expanded."""
    known = _PREFIXES | (prefixes or {})

    def term(x: str) -> str:
        if x.startswith("?"):
            return x
        if x.startswith("<"):
            return x[1:-1]
        prefix, sep, local = x.partition(":")
        return known[prefix] + local if sep and prefix in known else x

    def patterns(side: str) -> tuple:
        return tuple(tuple(term(x) for x in p.split()) for p in re.findall(r"\(([^()]*)\)", side))

    body, _, head = text.partition("->")
    return Rule(name, patterns(body), patterns(head))


# The entailment rules of the standards, by their names there.
_IN, _ALL, _BAD = "urn:loomgraph:in", "urn:loomgraph:all", "urn:loomgraph:inconsistent"
RDFS_RULES = [
    rule("rdfs2", "(?p rdfs:domain ?c) (?x ?p ?y) -> (?x rdf:type ?c)"),
    rule("rdfs3", "(?p rdfs:range ?c) (?x ?p ?y) -> (?y rdf:type ?c)"),
    rule("rdfs5", "(?p rdfs:subPropertyOf ?q) (?q rdfs:subPropertyOf ?r) -> (?p rdfs:subPropertyOf ?r)"),
    rule("rdfs7", "(?p rdfs:subPropertyOf ?q) (?x ?p ?y) -> (?x ?q ?y)"),
    rule("rdfs9", "(?c rdfs:subClassOf ?d) (?x rdf:type ?c) -> (?x rdf:type ?d)"),
    rule("rdfs11", "(?c rdfs:subClassOf ?d) (?d rdfs:subClassOf ?e) -> (?c rdfs:subClassOf ?e)"),
]
OWL_RULES = [
    *RDFS_RULES,
    rule("prp-symp", "(?p rdf:type owl:SymmetricProperty) (?x ?p ?y) -> (?y ?p ?x)"),
    rule("prp-trp", "(?p rdf:type owl:TransitiveProperty) (?x ?p ?y) (?y ?p ?z) -> (?x ?p ?z)"),
    rule("prp-inv1", "(?p owl:inverseOf ?q) (?x ?p ?y) -> (?y ?q ?x)"),
    rule("prp-inv2", "(?p owl:inverseOf ?q) (?x ?q ?y) -> (?y ?p ?x)"),
    rule("prp-fp", "(?p rdf:type owl:FunctionalProperty) (?x ?p ?y) (?x ?p ?z) -> (?y owl:sameAs ?z)"),
    rule("prp-ifp", "(?p rdf:type owl:InverseFunctionalProperty) (?x ?p ?z) (?y ?p ?z) -> (?x owl:sameAs ?y)"),
    rule("prp-eqp1", "(?p owl:equivalentProperty ?q) -> (?p rdfs:subPropertyOf ?q) (?q rdfs:subPropertyOf ?p)"),
    rule("cax-eqc", "(?c owl:equivalentClass ?d) -> (?c rdfs:subClassOf ?d) (?d rdfs:subClassOf ?c)"),
    rule("cls-hv1", "(?r owl:hasValue ?v) (?r owl:onProperty ?p) (?x rdf:type ?r) -> (?x ?p ?v)"),
    rule("cls-hv2", "(?r owl:hasValue ?v) (?r owl:onProperty ?p) (?x ?p ?v) -> (?x rdf:type ?r)"),
    rule("cls-svf1", "(?r owl:someValuesFrom ?c) (?r owl:onProperty ?p) (?x ?p ?y) (?y rdf:type ?c) -> (?x rdf:type ?r)"),
    rule("cls-avf", "(?r owl:allValuesFrom ?c) (?r owl:onProperty ?p) (?x rdf:type ?r) (?x ?p ?y) -> (?y rdf:type ?c)"),
    rule("eq-sym", "(?x owl:sameAs ?y) -> (?y owl:sameAs ?x)"),
    rule("eq-trans", "(?x owl:sameAs ?y) (?y owl:sameAs ?z) -> (?x owl:sameAs ?z)"),
    rule("eq-rep-s", "(?x owl:sameAs ?y) (?x ?p ?o) -> (?y ?p ?o)"),
    rule("eq-rep-o", "(?x owl:sameAs ?y) (?s ?p ?x) -> (?s ?p ?y)"),
    rule("eq-rep-p", "(?p owl:sameAs ?q) (?x ?p ?y) -> (?x ?q ?y)"),
    rule("prp-spo2", f"(?p owl:propertyChainAxiom ?l) (?l rdf:first ?a) (?l rdf:rest ?m) (?m rdf:first ?b) (?m rdf:rest <{RDF}nil>) (?x ?a ?y) (?y ?b ?z) -> (?x ?p ?z)"),
    rule("cls-svf2", f"(?r owl:someValuesFrom <{OWL}Thing>) (?r owl:onProperty ?p) (?x ?p ?y) -> (?x rdf:type ?r)"),
    # Lists: what is in one, and what has all the types in one (from its end).
    rule("list-first", f"(?l rdf:first ?x) -> (?l <{_IN}> ?x)"),
    rule("list-rest", f"(?l rdf:rest ?m) (?m <{_IN}> ?x) -> (?l <{_IN}> ?x)"),
    rule("list-all-end", f"(?l rdf:rest <{RDF}nil>) (?l rdf:first ?c) (?x rdf:type ?c) -> (?x <{_ALL}> ?l)"),
    rule("list-all", f"(?l rdf:rest ?m) (?x <{_ALL}> ?m) (?l rdf:first ?c) (?x rdf:type ?c) -> (?x <{_ALL}> ?l)"),
    rule("cls-int1", f"(?c owl:intersectionOf ?l) (?x <{_ALL}> ?l) -> (?x rdf:type ?c)"),
    rule("cls-int2", f"(?c owl:intersectionOf ?l) (?l <{_IN}> ?d) (?x rdf:type ?c) -> (?x rdf:type ?d)"),
    rule("cls-uni", f"(?c owl:unionOf ?l) (?l <{_IN}> ?d) (?x rdf:type ?d) -> (?x rdf:type ?c)"),
    rule("cls-oo", f"(?c owl:oneOf ?l) (?l <{_IN}> ?x) -> (?x rdf:type ?c)"),
    rule("scm-int", f"(?c owl:intersectionOf ?l) (?l <{_IN}> ?d) -> (?c rdfs:subClassOf ?d)"),
    rule("scm-uni", f"(?c owl:unionOf ?l) (?l <{_IN}> ?d) -> (?d rdfs:subClassOf ?c)"),
    rule("scm-dom1", "(?p rdfs:domain ?c) (?c rdfs:subClassOf ?d) -> (?p rdfs:domain ?d)"),
    rule("scm-dom2", "(?p rdfs:domain ?c) (?q rdfs:subPropertyOf ?p) -> (?q rdfs:domain ?c)"),
    rule("scm-rng1", "(?p rdfs:range ?c) (?c rdfs:subClassOf ?d) -> (?p rdfs:range ?d)"),
    rule("scm-rng2", "(?p rdfs:range ?c) (?q rdfs:subPropertyOf ?p) -> (?q rdfs:range ?c)"),
    rule("scm-hv", "(?c owl:hasValue ?v) (?c owl:onProperty ?p) (?d owl:hasValue ?v) (?d owl:onProperty ?q) (?p rdfs:subPropertyOf ?q) -> (?c rdfs:subClassOf ?d)"),
    rule("scm-svf1", "(?c owl:someValuesFrom ?x) (?c owl:onProperty ?p) (?d owl:someValuesFrom ?y) (?d owl:onProperty ?p) (?x rdfs:subClassOf ?y) -> (?c rdfs:subClassOf ?d)"),
    rule("scm-avf1", "(?c owl:allValuesFrom ?x) (?c owl:onProperty ?p) (?d owl:allValuesFrom ?y) (?d owl:onProperty ?p) (?x rdfs:subClassOf ?y) -> (?c rdfs:subClassOf ?d)"),
]
#: What no consistent graph has.
INCONSISTENT = [
    rule("cax-dw", f"(?c owl:disjointWith ?d) (?x rdf:type ?c) (?x rdf:type ?d) -> (?x <{_BAD}> ?c)"),
    rule("cls-com", f"(?c owl:complementOf ?d) (?x rdf:type ?c) (?x rdf:type ?d) -> (?x <{_BAD}> ?c)"),
    rule("cls-nothing2", f"(?x rdf:type <{OWL}Nothing>) -> (?x <{_BAD}> <{OWL}Nothing>)"),
    rule("eq-diff1", f"(?x owl:sameAs ?y) (?x owl:differentFrom ?y) -> (?x <{_BAD}> ?y)"),
    rule("prp-irp", f"(?p rdf:type owl:IrreflexiveProperty) (?x ?p ?x) -> (?x <{_BAD}> ?p)"),
    rule("prp-asyp", f"(?p rdf:type owl:AsymmetricProperty) (?x ?p ?y) (?y ?p ?x) -> (?x <{_BAD}> ?p)"),
    rule("prp-pdw", f"(?p owl:propertyDisjointWith ?q) (?x ?p ?y) (?x ?q ?y) -> (?x <{_BAD}> ?p)"),
]


def inconsistencies(triples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rule, s, o): the subjects, and the classes, properties or partners, that break a graph with what follows from it."""
    derived = materialize(triples, OWL_RULES if rules is None else rules)
    whole = Rounds(triples.sparkSession, "consistent").save(triples.select("s", "p", "o").union(derived.select("s", "p", "o")).distinct())
    out = None
    for r in INCONSISTENT:
        part = _heads(r, _body(r, [whole] * len(r.body))).select(F.lit(r.name).alias("rule"), "s", "o")
        out = part if out is None else out.union(part)
    return out.distinct()


def _pattern(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    names: dict[str, str] = {}
    for col, x in zip(("s", "p", "o"), pattern):
        if x.startswith("?"):
            if x[1:] in names:
                triples = triples.where(F.col(col) == F.col(names[x[1:]]))
            else:
                names[x[1:]] = col
        else:
            triples = triples.where(F.col(col) == x)
    return triples.select(*[F.col(c).alias(v) for v, c in names.items()])


def _connected(body: tuple) -> list[int]:
    """Places of the patterns: each shares a variable with one before it, as long as there is such a one."""
    names = [{x for x in pattern if x.startswith("?")} for pattern in body]
    order, bound, left = [], set(), list(range(len(body)))
    while left:
        at = next((i for i in left if names[i] & bound), left[0])
        order.append(at)
        bound |= names[at]
        left.remove(at)
    return order


def _body(rule: Rule, sources: list[DataFrame]) -> DataFrame:
    out = None
    for i in _connected(rule.body):
        part = _pattern(sources[i], rule.body[i])
        if out is None:
            out = part
            continue
        shared = [c for c in part.columns if c in out.columns]
        if not shared:
            raise ValueError(f"rule {rule.name!r}: a pattern shares nothing with the others")
        out = out.join(part, shared)
    return out


def _heads(rule: Rule, found: DataFrame) -> DataFrame:
    out = None
    for pattern in rule.head:
        cols = [F.col(x[1:]) if x.startswith("?") else F.lit(x) for x in pattern]
        part = found.select(*[c.alias(n) for c, n in zip(cols, ("s", "p", "o"))])
        out = part if out is None else out.union(part)
    return out


def materialize(triples: DataFrame, rules: list[Rule] | None = None, explain: bool = False, most: int = 1000, literals: str = "s is not null") -> DataFrame:
    """The derived triples (s, p, o), without the given ones; with ``explain`` also the rule.

    Literals cannot be subjects: ``literals`` is the condition for a subject.
    A resource is not said to be the same as itself.
    """
    rules = RDFS_RULES if rules is None else rules
    rounds = Rounds(triples.sparkSession, "derive", keep=10_000)
    base = rounds.save(triples.select("s", "p", "o").distinct().withColumn("rule", F.lit(None).cast("string")))
    known, new = [base], base
    for _ in range(most):
        everything = known[0]
        for k in known[1:]:
            everything = everything.union(k)
        found = None
        for r in rules:
            for i in range(len(r.body)):
                part = _heads(r, _body(r, [new if j == i else everything for j in range(len(r.body))])).withColumn("rule", F.lit(r.name))
                found = part if found is None else found.union(part)
                if new is base:
                    break  # in the first round everything is new
        found = found.where(literals).where(~((F.col("p") == OWL + "sameAs") & (F.col("s") == F.col("o")))).groupBy("s", "p", "o").agg(F.min("rule").alias("rule"))
        new = rounds.save(found.join(everything.select("s", "p", "o"), ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            break
        known.append(new)
        if len(known) > 8:
            merged = known[1]
            for k in known[2:]:
                merged = merged.union(k)
            known = [base, rounds.save(merged)]
    else:
        raise RuntimeError(f"rules still derive triples after {most} rounds")
    out = known[1] if len(known) > 1 else new
    for k in known[2:]:
        out = out.union(k)
    out = out.where(~F.col("p").isin(_IN, _ALL))
    return out if explain else out.drop("rule")


def explain(triple: tuple[str, str, str], given: DataFrame, derived: DataFrame, rules: list[Rule], depth: int = 8) -> dict:
    """A derivation tree of one triple: asserted, derived (with rule and premises) or unexplained."""
    s, p, o = triple
    here = (F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)
    if not given.where(here).isEmpty():
        return {"triple": triple, "kind": "asserted"}
    row = derived.where(here).select("rule").limit(1).collect()
    if not row or not depth:
        return {"triple": triple, "kind": "unexplained"}
    everything = given.select("s", "p", "o").union(derived.select("s", "p", "o"))
    for r in [x for x in rules if x.name == row[0][0]]:
        for head in r.head:
            bound: dict[str, str] = {}
            if not all(bound.setdefault(h[1:], v) == v if h.startswith("?") else h == v for h, v in zip(head, triple)):
                continue
            body = tuple(tuple(bound.get(x[1:], x) if x.startswith("?") else x for x in b) for b in r.body)
            first = _solve(body, everything)
            if first is not None:
                premises = [tuple(first.get(x[1:], x) if x.startswith("?") else x for x in b) for b in body]
                return {"triple": triple, "kind": "derived", "rule": r.name, "premises": [explain(t, given, derived, rules, depth - 1) if t != triple else {"triple": t, "kind": "ref"} for t in premises]}
    return {"triple": triple, "kind": "unexplained"}


def _solve(body: tuple, triples: DataFrame) -> dict[str, str] | None:
    out = None
    order = _connected(body)
    for n, i in enumerate(order):
        pattern = body[i]
        part = _pattern(triples, pattern)
        if not part.columns:
            part = triples.where((F.col("s") == pattern[0]) & (F.col("p") == pattern[1]) & (F.col("o") == pattern[2])).select(F.lit(1).alias("_one"))
        shared = [c for c in part.columns if out is not None and c in out.columns and c != "_one"]
        if out is not None and not shared:
            # One row will do for a pattern that no later one shares a variable with.
            more = {x[1:] for j in order[n + 1 :] for x in body[j] if x.startswith("?")}
            part = part if more & set(part.columns) else F.broadcast(part.limit(1))
        out = part if out is None else out.join(part, shared) if shared else out.crossJoin(part.drop("_one") if "_one" in out.columns else part)
    row = out.limit(1).collect()
    return {k: v for k, v in row[0].asDict().items() if not k.startswith("_")} if row else None


# ---------------------------------------------------------------- on read


def closed(schema: DataFrame, predicate: str) -> DataFrame:
    """(sub, sup): the transitive closure of a hierarchy, with every member under itself."""
    from . import paths

    class _Holder:
        spark = schema.sparkSession

    edges = schema.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    pairs = paths.closure(_Holder, edges)
    return pairs.union(paths.zero(edges)).distinct().select(F.col("src").alias("sub"), F.col("dst").alias("sup"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows it small, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rdfs_on_read(data: DataFrame, schema: DataFrame) -> DataFrame:
    """``data`` with what RDFS makes of it under a separate schema: superproperties, domains, ranges, superclasses.

    A domain or range belongs to the property that declares it and is not passed
    down to subproperties; a subproperty of rdf:type types resources.
    """
    supers, classes = _small(closed(schema, SUBPROPERTY)), _small(closed(schema, SUBCLASS))
    data = data.select("s", "p", "o")
    wider = data.join(supers, data["p"] == supers["sub"]).select("s", F.col("sup").alias("p"), "o")
    flat = data.union(wider).distinct()
    ends = []
    for predicate, col in ((DOMAIN, "s"), (RANGE, "o")):
        declared = _small(schema.where(F.col("p") == predicate).select(F.col("s").alias("_p"), F.col("o").alias("_c")))
        ends.append(data.join(declared, F.col("p") == F.col("_p")).select(F.col(col).alias("s"), F.lit(TYPE).alias("p"), F.col("_c").alias("o")))
    typed = flat.where(F.col("p") == TYPE).union(ends[0]).union(ends[1]).distinct()
    up = typed.join(classes, typed["o"] == classes["sub"]).select("s", "p", F.col("sup").alias("o"))
    return flat.union(typed).union(up).distinct()


def classify(axioms: DataFrame) -> DataFrame:
    """(sub, sup) of all class names: OWL 2 EL completion.

    ``axioms`` has (kind, a, b, c): ``sub`` a under b; ``and`` a and b under c;
    ``some`` a under some b of c; ``from`` some a of b under c; ``role`` a under b.
    """
    rounds = Rounds(axioms.sparkSession, "el", keep=10_000)
    axioms = rounds.save(axioms)
    kind = lambda k: axioms.where(F.col("kind") == k)
    named = axioms.select(F.explode(F.when(F.col("kind") == "role", F.array()).when(F.col("kind") == "sub", F.array("a", "b")).when(F.col("kind") == "and", F.array("a", "b", "c")).when(F.col("kind") == "some", F.array("a", "c")).otherwise(F.array("b", "c"))).alias("x")).distinct()
    sub = rounds.save(named.select(F.col("x").alias("x"), F.col("x").alias("y")))
    link = rounds.save(axioms.where("false").select(F.col("a").alias("x"), F.col("b").alias("r"), F.col("c").alias("y")))
    while True:
        told = sub.join(kind("sub").select(F.col("a").alias("y"), F.col("b").alias("z")), "y").select("x", F.col("z").alias("y"))
        both = sub.select("x", F.col("y").alias("a")).join(kind("and").select("a", "b", "c"), "a").join(sub.select("x", F.col("y").alias("b")), ["x", "b"]).select("x", F.col("c").alias("y"))
        some = sub.join(kind("some").select(F.col("a").alias("y"), F.col("b").alias("r"), F.col("c").alias("z")), "y").select("x", "r", F.col("z").alias("y"))
        wider = link.join(kind("role").select(F.col("a").alias("r"), F.col("b").alias("q")), "r").select("x", F.col("q").alias("r"), "y")
        back = link.join(sub.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").join(kind("from").select(F.col("a").alias("r"), F.col("b").alias("z"), F.col("c").alias("w")), ["r", "z"]).select("x", F.col("w").alias("y"))
        now = rounds.save(sub.union(told).union(both).union(back).distinct())
        links = rounds.save(link.union(some).union(wider).distinct())
        if now.count() == sub.count() and links.count() == link.count():
            return now.where("x != y").select(F.col("x").alias("sub"), F.col("y").alias("sup"))
        sub, link = now, links
