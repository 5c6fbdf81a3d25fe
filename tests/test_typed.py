"""Calls through types against a plain resolver; constants and properties against plain substitution; sources to edges."""

import random
import re

import pytest
from archgraph.operators import build, constants, typed
from archgraph.sources import extract
from archgraph.sources.shared import written
from pyspark.sql import functions as F


def staging(spark, files):
    return written(extract.java_staging(spark.createDataFrame(files, "path string, text string").repartition(3)))


class Forest:
    """Random classes: parents, interfaces, overloaded methods, fields, nested classes of one name; and what calls mean, found by walking."""

    def __init__(self, seed, n=40):
        rnd = random.Random(seed)
        self.n, self.parent, self.interfaces = n, {}, {}
        for k in range(n):
            self.parent[k] = rnd.randrange(k) if k and rnd.random() < 0.7 else None
        self.has = {k: sorted({(f"m{rnd.randrange(4)}", rnd.randrange(3)) for _ in range(rnd.randrange(4))}) for k in range(n)}
        self.result = {(k, *m): rnd.randrange(n) for k in range(n) for m in self.has[k]}
        self.field = {k: rnd.randrange(n) for k in range(n)}
        self.calls = {k: [[rnd.choice(["f", "this", "super", "v", "g"]), *[(f"m{rnd.randrange(4)}", rnd.randrange(3)) for _ in range(rnd.randint(1, 4))]] for _ in range(3)] for k in range(n)}

    def text(self, k):
        args = lambda a: ", ".join(["(1 + 2)"] * a)
        methods = " ".join(f"C{self.result[k, m, a]} {m}({', '.join(f'int p{i}' for i in range(a))}) {{ return null; }}" for m, a in self.has[k])
        chains = " ".join(f"{c[0]}.{'.'.join(f'{m}({args(a)})' for m, a in c[1:])};" for c in self.calls[k])
        parent = f"extends C{self.parent[k]} " if self.parent[k] is not None else ""
        field = f"C{self.field[k]} f;" if k % 3 else ""
        return f"package p{k % 2}; import p0.*; import p1.*; class C{k} {parent}{{ {field} private C{self.field[k]} g = null; /* x.m0() */ {methods} void run() {{ String s = \"f.m1()\"; C{self.field[k]} v = g; {chains} }} }}"

    def definer(self, k, m, a):
        chain = []
        while k is not None:
            chain.append(k)
            k = self.parent[k]
        for exact in (True, False):
            for c in chain:
                for name, takes in self.has[c]:
                    if name == m and (takes == a or not exact):
                        # Of several that do not fit the first in the file counts.
                        return c, name, takes
        return None

    def holder(self, k, name):
        while k is not None:
            if name == "g" or k % 3:
                return self.field[k]
            k = self.parent[k]
        return None

    def expected(self):
        out = []
        for k in range(self.n):
            for c in self.calls[k]:
                at = {"this": k, "super": self.parent[k], "v": self.field[k]}.get(c[0]) if c[0] in ("this", "super", "v") else self.holder(k, c[0])
                for m, a in c[1:]:
                    hit = self.definer(at, m, a) if at is not None else None
                    if hit is None:
                        break
                    out.append((k, hit))
                    at = self.result[hit]
        return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_equal_a_plain_resolver_on_random_forests(spark, seed):
    forest = Forest(seed)
    rows = staging(spark, [(f"C{k:03}.java", forest.text(k)) for k in range(forest.n)])
    project = typed.Hierarchy(rows)
    named = {r["method_id"]: (int(r["type_id"].rpartition("C")[2]), r["name"], r["arity"]) for r in project.methods.collect()}
    got = sorted((named[r["caller"]][0], named[r["callee"]]) for r in project.resolved(rows).filter("callee IS NOT NULL").collect())
    assert got == forest.expected()


def test_closure_of_a_long_chain_and_a_circle(spark):
    edges = [(f"t{k}", f"t{k + 1}", 0) for k in range(37)] + [("a", "b", 0), ("b", "a", 0), ("t0", "t5", 1)]
    got = {(r["sub"], r["super"]): r["distance"] for r in typed.ancestors(spark.createDataFrame(edges, "sub string, super string, rank int")).collect()}
    assert got["t0", "t37"] == 33 and got["t1", "t37"] == 36 and got["a", "b"] == 1 and ("a", "a") not in got
    assert len(got) == 37 * 38 // 2 + 2


FILES = [
    ("S.java", """package a.b;
import x.y.R;
@Service class S extends Base { private final R repo; P port;
 N store(N n, List<String> names) { repo.list().stream().map(z); var v = repo.find(n); v.run(); this.repo.save(n, names.get(1)); helper(); port.send(n).run(); In i = new In(); i.go(); return n; }
 void stream() {} void map(int a) {}
 class In { void go() { store(null, null); super.go(); } } }"""),
    ("Base.java", "package a.b; abstract class Base { void helper() { } }"),
    ("T.java", "package a.b; @Service class T { class In { void go() {} } }"),
    ("R.java", "package x.y; @Repository interface R extends Store<N> { List<N> list(); a.b.N find(a.b.N n); } interface Store<E> { E save(E n, String s); E save(E n); }"),
    ("N.java", "package a.b; class N { void run() {} }"),
    ("P.java", "package a.b; interface P { N send(N n); } class Q implements P { public N send(N n) { return n; } }"),
]


def test_receivers(spark):
    rows = staging(spark, FILES)
    got = {(r["member"], r["receiver"]): r["callee"] for r in typed.Hierarchy(rows).resolved(rows).collect()}
    assert got == {
        ("list", "name"): "R.java#0", ("stream", "chain"): None, ("map", "chain"): None, ("find", "name"): "R.java#1", ("run", "chain"): "N.java#0", ("save", "name"): "R.java#2", ("get", "typed"): None,
        ("helper", "self"): "Base.java#0", ("send", "name"): "P.java#1", ("In", "new"): None, ("go", "typed"): "S.java#3", ("store", "self"): "S.java#0", ("go", "super"): None,
    }


def test_nested_types_and_inherited_methods_in_the_graph(spark):
    nodes, edges = build.graph_of(staging(spark, FILES), F.lit("app"))
    got = {(r["src"], r["dst"]) for r in edges.filter("type = 'CALLS'").collect()}
    run = next(s for s, _ in got if s.startswith("method:a.b.S.store"))
    assert {d for s, d in got if s == run} == {"method:x.y.R.list()", next(d for _, d in got if d.startswith("method:x.y.R.find")), next(d for _, d in got if "Store.save" in d), "method:a.b.Base.helper()"}
    assert {r["id"] for r in nodes.filter("type = 'Inherited'").collect()} == {"service:a.b.Base", "service:x.y.Store"}


def test_endpoint_reaches_the_service_method(spark):
    """A controller's endpoint calls a service, which calls another of its methods."""
    text = """package a; @RestController @RequestMapping("/o") class C { private final S s; @GetMapping("/{id}") N one(String id) { return s.load(id); } }
@Service class S { N load(String id) { return check(id); } N check(String id) { return null; } } class N { }"""
    edges = build.graph_of(staging(spark, [("C.java", text)]), F.lit("app"))[1]
    got = sorted((r["src"].split(":")[0], r["dst"]) for r in edges.filter("type = 'CALLS'").collect())
    assert got == [("endpoint", "method:a.S.load(String)"), ("method", "method:a.S.check(String)")]


def test_a_method_of_many_calls_keeps_them(spark):
    calls = " ".join(f"s.m{k}();" for k in range(1_100))
    methods = " ".join(f"void m{k}() {{ }}" for k in range(1_100))
    rows = staging(spark, [("C.java", f"class C {{ S s; void a() {{ {calls} }} void b() {{ }} }} class S {{ {methods} }}")])
    got = typed.Hierarchy(rows).resolved(rows).filter("callee IS NOT NULL").groupBy("caller").count().collect()
    assert [(r["caller"], r["count"]) for r in got] == [("C.java#0", 1_100)]


def put_in(text, symbols, circular=frozenset()):
    """Plain substitution of one text by a walk."""
    def one(m):
        name, default = m[1], m[2]
        if name in symbols and not (symbols[name] == "" and default is not None):
            value = resolve(name)
            return m[0] if value is None else value
        return default if default is not None else "\x01{" + m[0][2:]

    def resolve(name, path=()):
        return None if name in circular else put_in(symbols[name], symbols, circular).replace("${", "\x01{") if name in symbols else None

    while (new := re.sub(r"\$\{([^${}:]+)(?::([^${}]*))?\}", one, text)) != text:
        text = new
    return text.replace("\x01{", "${")


def test_settled_symbols_equal_plain_substitution(spark):
    rnd = random.Random(9)
    # Each names later ones only, but for a few circles; some names have no value.
    symbols = {}
    for k in range(120):
        parts = [rnd.choice([f"t{k}", f"${{s{rnd.randint(k + 1, 130)}}}", f"${{s{rnd.randint(k + 1, 130)}:d{k}}}", f"${{s{rnd.randint(k + 1, 130)}:x${{s{rnd.randint(k + 1, 130)}:y}}z}}"]) for _ in range(rnd.randint(0, 3))]
        symbols[f"s{k}"] = "/".join(parts)
    want = {k: put_in(v, symbols) for k, v in symbols.items()}
    rings = {"c1": "${c2}!", "c2": "a${c1:q}", "c3": "${c3}", "c4": "<${c1}>"}
    df = spark.createDataFrame([*symbols.items(), *rings.items()], "symbol string, value string")
    got = {r["symbol"]: r["value"] for r in constants.settled(df).collect()}
    assert {k: v for k, v in got.items() if k in rings} == rings
    assert {k: v for k, v in got.items() if k not in rings} == want


def test_texts_of_all_files(spark):
    files = [
        ("S.java", """package a.b; import k.Topics;
@Service class S { KafkaTemplate kafka; WebClient web; UserClient users; RestTemplate rest; @Value("${app.url:http://d}") String url; static final String P = Urls.BASE + "/x";
 void store(N n) { kafka.send(Topics.OUT, n); web.get().uri(url + "/u/" + n.id).retrieve(); users.find("1"); users.raw(); rest.postForObject(P + "/y", n); rest.getForObject(n.url() + P, n); } }"""),
        ("Urls.java", 'package a.b; class Urls { static final String BASE = Hosts.H + "/api"; } class Hosts { static final String H = "http://h"; static final String A = B + "x"; static final String B = A; }'),
        ("Topics.java", 'package k; class Names { static final String IN = "in-${env}"; } class Topics extends Names { static final String OUT = "${k.out:dflt-${env}}"; }'),
        ("U.java", 'package a.b; @FeignClient(name="u") @RequestMapping("/base") interface UserClient { @PostMapping("/users/{id}") String find(String s); String raw(); }'),
        ("L.java", 'package a.b; import k.*; @Component class L { @KafkaListener(topics = {"${app.topic:def}", Topics.IN}, groupId = "g") void on(String m) { } @KafkaListener(topics = "${none}") void on2(String m) {} @KafkaListener(topics = "${c1}") void on3(String m) {} }'),
    ]
    properties = spark.createDataFrame([("env", "prod"), ("app.topic", "t-${env}"), ("c1", "${c2}"), ("c2", "${c1}")], "key string, value string")
    edges = build.graph_of(staging(spark, files), F.lit("app"), properties)[1].collect()
    of = lambda kind: sorted(r["dst"] for r in edges if r["type"] == kind)
    assert of("PRODUCES_TO") == ["kafka_topic:dflt-prod"]
    assert of("CONSUMES_FROM") == sorted(["kafka_topic:t-prod", "kafka_topic:in-prod", "kafka_topic:${none}", "kafka_topic:${c1}"])
    assert of("MAKES_EXTERNAL_CALL") == sorted(f"external:{x}:resolved=false" for x in ("GET:/u/{*}", "POST:/base/users/{*}", "REQUEST:{*}", "POST:/api/x/y", "GET:{*}http://h/api/x"))
