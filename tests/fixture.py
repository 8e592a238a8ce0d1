"""A small log across three namespaces: a kitchen's recipes, its batches, and a tasting agent."""

from strandline.model import Log, external_key, internal_key


def key(ns, kind, id):
    return external_key(ns, kind, id)


def string(**attrs):
    return {n.replace("_", "-"): ("string", str(v)) for n, v in attrs.items()}


RECIPE, OLD_RECIPE = key("book", "recipe", "r-2"), key("book", "recipe", "r-1")
BATCH, FLOUR, OVEN = key("kitchen", "batch", "b-7"), key("kitchen", "lot", "flour-3"), key("kitchen", "oven", "left")
TASTING = key("agent", "event", "t-1/start")
NEVER_SEEN = key("kitchen", "batch", "b-6")

#: relation: namespace, name, from, to, role, direction, event, operation
RELATIONS = [
    ("book", "revises", RECIPE, OLD_RECIPE, "supporting", "from-explained-by-to", "e-book", "op-book"),
    ("kitchen", "follows", BATCH, NEVER_SEEN, "supporting", "from-explained-by-to", "e-kitchen", "op-kitchen"),
    ("kitchen", "uses", BATCH, FLOUR, "primary", "from-explained-by-to", "e-kitchen", "op-kitchen"),
    ("kitchen", "bakes", OVEN, BATCH, "contextual", "to-explained-by-from", "e-kitchen", "op-kitchen"),
    ("agent", "tasted", TASTING, RECIPE, "causal", "to-explained-by-from", "e-agent", "op-agent"),
    ("agent", "compares", TASTING, BATCH, "contextual", "symmetric", "e-agent", "op-agent"),
    ("agent", "disputes", TASTING, FLOUR, "contradicting", "subject-explained-by-object", "e-agent", "op-agent"),
]


def kitchen(spark) -> Log:
    kinds = lambda e: e.split("\0")[1:3]
    schemas = [(ns, "1", ns, name, "external", *kinds(a), "external", *kinds(b), role, way) for ns, name, a, b, role, way, *_ in RELATIONS]
    observe = lambda op, at, entity, **attrs: (op, at, entity, entity.split("\0")[1], "1", string(**attrs))
    tasting = string(name="tasting", event_kind="tool", timestamp="2030-05-01T12:30:00Z", outcome="salty", trace_id="tr-1", span_id="sp-1", provider="ovenscope", zest="secret") | {"edits": ("int", "3")}
    return Log.of(
        spark,
        operations=[
            ("op-root", None, string(note="schemas")),
            ("op-book", key("book", "hook", "update/r-2"), string(source_system="shelf")),
            ("op-kitchen", BATCH, string(source_system="range")),
            ("op-agent", TASTING, string(projection="audit")),
        ],
        parents=[("op-book", "op-root"), ("op-kitchen", "op-root"), ("op-agent", "op-book"), ("op-agent", "op-kitchen")],
        schemas=[("op-root", i, ns, "1") for i, ns in enumerate(("book", "kitchen", "agent"))],
        relation_schemas=schemas,
        observations=[
            observe("op-book", 0, RECIPE, title='Bread "rustic"', status="trial", updated_at="2030-05-01T12:00:05Z"),
            observe("op-book", 1, OLD_RECIPE, title="Bread", status="Closed"),
            observe("op-kitchen", 0, BATCH, description="First of the day"),
            observe("op-kitchen", 1, FLOUR, name="Flour", timestamp="1900000000000@60"),
            observe("op-kitchen", 2, OVEN, name="Left oven", status="warm"),
            observe("op-agent", 2, TASTING, **{"name": "tasting", "outcome": "salty"}),
        ],
        events=[
            ("op-book", 2, "e-book", None, None, string(hook="update")),
            ("op-kitchen", 3, "e-kitchen", None, None, string(operation_kind="bake", timestamp="2030-05-01T11:59:58+02:00")),
            ("op-agent", 3, "e-agent", "s-1", "a-1", tasting),
        ],
        event_parents=[("e-agent", "e-book")],
        subjects=[("e-book", RECIPE), ("e-kitchen", BATCH), ("e-kitchen", OVEN), ("e-agent", TASTING), ("e-agent", RECIPE)],
        relations=[(op, event, ns, "1", ns, name, a, b, "[]") for ns, name, a, b, _, _, event, op in RELATIONS],
        requires=[("e-agent", TASTING, 2)],
        sessions=[("op-agent", 0, "s-1", None, string(harness_id="spoon") | {"files": ("int", "2")})],
        actors=[("op-agent", 1, "a-1", "s-1", string(role="taster"))],
        claims=[("op-agent", 4, "c-1", "event", "e-agent", TASTING, 2)],
        resources=[("op-agent", 5, TASTING, "local", "verified", 2)],
        named_queries=[
            ("op-root", 3, "book", "1", "why", "external", "book", "recipe", "explain", 1, ["causal"], None, None, []),
            ("op-root", 4, "book", "1", "past", "any", None, None, "history", None, [], None, None, []),
            ("op-root", 5, "book", "1", "onward", "external", "book", "recipe", "traverse", 1, [], "both", "types", ["book/revises"]),
        ],
    )


INTERNAL = internal_key("session", "s-1")
