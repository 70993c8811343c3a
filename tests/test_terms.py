import random
import textwrap

import pytest

from gleanery.functions.forms import UNIT, Form, Pattern, anchor_names, canonical, dumps, interrupts, is_reportable, is_trivial, loads, metrics, node_rows, select, sequence
from gleanery.functions.rewrite import simplify
from gleanery.functions.unify import contains, equal_up_to_names, locate
from gleanery.sources.python_frontend import bare_calls, functions


def lower(source):
    return [f for _, _, _, f in functions(textwrap.dedent(source))]


def local(n):
    return Form("local", n)


def bind(n):
    return Pattern("bind", n)


def random_form(rng, depth=4):
    kind = rng.choice(["local", "num", "path", "method", "binary", "traverse", "branch", "do", "collect", "return", "let", "select"] if depth else ["local", "num", "path", "lit"])
    sub = lambda: random_form(rng, depth - 1)
    n = rng.randrange(4)
    if kind in ("local",):
        return local(n)
    if kind in ("num", "path"):
        return Form(kind, str(n))
    if kind == "lit":
        return Form("lit")
    if kind == "method":
        return Form("method", rng.choice(["push", "get"]), (sub(), sub()))
    if kind == "binary":
        return Form("binary", rng.choice("+-"), (sub(), sub()))
    if kind == "traverse":
        return Form("traverse", None, (sub(), sub()), (bind(n),))
    if kind == "branch":
        return Form("branch", None, (sub(), sub()))
    if kind == "do":
        return sequence([sub(), sub(), sub()])
    if kind == "collect":
        return Form("collect", rng.choice([None, "list"]), (sub(),))
    if kind == "return":
        return Form("return", None, (sub(),))
    if kind == "let":
        return Form("let", None, (sub(),), (bind(n),))
    return select(sub(), [(Pattern("variant", "B", (bind(n),)), sub()), (Pattern("variant", "A"), sub()), (Pattern("ignored"), sub())])


def test_terms_survive_their_json():
    rng = random.Random(1)
    for _ in range(300):
        f = random_form(rng)
        assert loads(dumps(f)) == f


def test_canonical_is_idempotent_and_blind_to_names():
    rng = random.Random(2)
    for _ in range(300):
        f = random_form(rng)
        c = canonical(f)
        assert canonical(c) == c
        names = {n: n + 17 for n in range(10)}

        def rename(x):
            out = x._replace(kids=tuple(rename(k) for k in x.kids), pats=tuple(p.renamed(names.get) for p in x.pats))
            return out._replace(label=names[x.label]) if x.tag == "local" else out

        assert canonical(rename(f)) == c


def test_simplify_is_idempotent():
    rng = random.Random(3)
    for _ in range(300):
        once = simplify(random_form(rng))
        assert simplify(once) == once


def test_every_term_holds_itself_and_its_parts():
    rng = random.Random(4)
    for _ in range(200):
        f = random_form(rng)
        assert contains(f, f)
        g = sequence([Form("path", "before"), f, Form("path", "after")])
        assert contains(g, f)
        # the prefilter never loses a match
        assert anchor_names(f) <= anchor_names(g)


def test_arms_are_ordered_with_catch_alls_last():
    s = select(local(0), [(Pattern("ignored"), UNIT), (Pattern("variant", "B"), UNIT), (Pattern("variant", "A"), UNIT)])
    assert [str(p) for p in s.pats] == ["(A)", "(B)", "_"]


def test_metrics_of_a_term():
    f = Form("traverse", None, (Form("free", 0), Form("method", "push", (Form("free", 1), local(0)))), (bind(0),))
    assert metrics(f) == {"size": 5, "depth": 3, "anchors": 1, "holes": 2}
    assert len(node_rows(f)) == 5 and not is_reportable(f) and is_trivial(local(1)) and not is_trivial(f)
    s = select(local(0), [(Pattern("variant", "A", (bind(1),)), local(1)), (Pattern("variant", "B"), UNIT)])
    assert metrics(s)["size"] == 4 + 3 and metrics(s)["anchors"] == 2


def test_a_filter_that_is_mapped_is_one_step():
    f = Form("transform", None, (Form("retain", None, (Form("free", 0), Form("method", "ok", (local(1),))), (bind(1),)), Form("method", "get", (local(2),))), (bind(2),))
    assert str(simplify(f)) == "(sift f0 v1 (branch (method ok v1) (variant Some (method get v1)) (variant None)))"


def test_the_first_kept_is_an_early_return():
    keep = Form("retain", None, (Form("free", 0), Form("method", "ok", (local(1),))), (bind(1),))
    assert str(simplify(Form("method", "first", (keep,)))) == "(do (traverse f0 v1 (branch (method ok v1) (return (variant Some v1)))) (variant None))"
    assert "traverse-back" in str(simplify(Form("method", "last", (keep,))))


def test_bound_lambdas_unfold_and_dead_ones_go():
    double = Form("let", None, (Form("lambda", None, (Form("binary", "+", (local(1), local(1))),), (bind(1),)),), (bind(0),))
    f = sequence([double, Form("return", None, (Form("call", None, (local(0), Form("num", "4"))),))])
    assert str(simplify(f)) == "(return (binary + (num 4) (num 4)))"
    loop = Form("let", None, (Form("lambda", None, (Form("call", None, (local(0), local(1))),), (bind(1),)),), (bind(0),))
    assert "lambda" in str(simplify(sequence([loop, Form("call", None, (local(0), Form("num", "1")))])))


def test_holes_bind_one_term_and_locals_one_local():
    p = Form("binary", "+", (Form("free", 0), Form("free", 0)))
    assert contains(Form("binary", "+", (Form("num", "1"), Form("num", "1"))), p)
    assert not contains(Form("binary", "+", (Form("num", "1"), Form("num", "2"))), p)
    xy = Form("binary", "+", (local(0), local(1)))
    assert not contains(Form("binary", "+", (local(5), local(5))), xy) and contains(Form("binary", "+", (local(5), local(6))), xy)


def test_an_applied_hole_stands_for_what_names_its_arguments():
    p = Form("transform", None, (Form("free", 0), Form("call", None, (Form("free", 1), local(0)))), (bind(0),))
    walk = lambda body: Form("transform", None, (Form("path", "xs"), body), (bind(7),))
    assert contains(walk(Form("method", "get", (local(7),))), p)
    assert not contains(walk(Form("num", "1")), p)
    assert not contains(walk(Form("return", None, (Form("method", "get", (local(7),)),))), p)


def test_steps_may_be_passed_unless_they_touch_what_is_bound():
    p = sequence([Form("let", None, (Form("construct", "list"),), (bind(0),)), Form("method", "sort", (local(0),))])
    start = Form("let", None, (Form("construct", "list"),), (bind(4),))
    sort = Form("method", "sort", (local(4),))
    assert contains(sequence([start, Form("method", "log", (Form("path", "x"),)), sort]), p)
    assert not contains(sequence([start, Form("method", "push", (local(4), Form("num", "1"))), sort]), p)


def test_a_fused_body_is_one_step_of_a_walk_that_does_not_leave():
    step = Form("method", "push", (Form("free", 1), local(0)))
    p = Form("traverse", None, (Form("free", 0), step), (bind(0),))
    own = Form("method", "push", (Form("path", "out"), local(3)))
    s = Form("traverse", None, (Form("path", "xs"), sequence([Form("method", "log", (local(3),)), own])), (bind(3),))
    left = Form("traverse", None, (Form("path", "xs"), sequence([own, Form("opaque", "break")])), (bind(3),))
    assert not contains(s, p) and contains(s, p, fused=True) and not contains(left, p, fused=True)
    assert interrupts(left) and not interrupts(s)


def test_containers_may_be_absent_and_a_catch_all_stands_for_an_arm():
    c = lambda x: Form("collect", x, (Form("path", "xs"),))
    assert contains(c("list"), c(None)) and contains(c(None), c("set")) and not contains(c("list"), c("set"))
    p = select(Form("free", 0), [(Pattern("variant", "Ok", (bind(0),)), local(0)), (Pattern("variant", "Err"), Form("num", "0"))])
    s = select(Form("path", "r"), [(Pattern("variant", "Ok", (bind(4),)), local(4)), (Pattern("ignored"), Form("num", "0"))])
    assert contains(s, p)


def test_places_are_steps_of_the_sequence():
    p = sequence([Form("method", "a", (Form("free", 0),)), Form("method", "b", (Form("free", 0),))])
    x = Form("path", "x")
    s = sequence([Form("path", "z"), Form("method", "a", (x,)), Form("path", "y"), Form("method", "b", (x,))])
    assert [(a, b) for _, a, b in locate(s, p)] == [(1, 3)]


def test_spellings_of_one_behaviour_are_one_term():
    a, b, c = lower(
        """
        def a(xs):
            out = []
            for x in xs:
                if x.ok:
                    out.append(x.value)
            return out
        def b(ys):
            return [y.value for y in ys if y.ok]
        def c(ys):
            '''The values.'''
            return [y.name for y in ys if y.ok]
        """
    )
    assert equal_up_to_names(a, b) and not equal_up_to_names(b, c)


def test_exceptions_tell_handlers_apart():
    a, b, c = lower(
        """
        def a(p):
            try:
                return p.read()
            except ValueError:
                return None
        def b(q):
            try:
                return q.read()
            except KeyError:
                return None
        def c(q):
            try:
                return q.read()
            except:
                return None
        """
    )
    assert len({str(canonical(f)) for f in (a, b, c)}) == 3 and "(BaseException)" in str(c)


def test_directions_and_counted_loops():
    a, b, c, d = lower(
        """
        def a(xs):
            for x in reversed(xs):
                f(x)
        def b(xs):
            for x in xs:
                f(x)
        def c(xs):
            i = 0
            while i < len(xs):
                f(xs[i])
                i += 1
        def d(n):
            while n:
                n = n.next
        """
    )
    assert "(traverse-back" in str(a) and "(traverse " in str(b) and "(traverse " in str(c) and "(while" in str(d)


def test_distinct_functions_have_distinct_terms():
    fs = lower("\n".join(f"def f{i}(a, b):\n    return a.m{i}(b) if a > {i} else [x + {i} for x in b]" for i in range(20)))
    assert len({str(canonical(f)) for f in fs}) == 20


def test_censuses():
    got = bare_calls("import os\ndef f(x):\n    g(len(x)); f(x); x.y()\n    while x < 3:\n        x += 1\n")
    assert got == {"bound": 1, "builtin": 1, "other": 1, "attribute": 1, "while_loops": 1, "while_walks": 1}


def test_all_of_the_standard_library_lowers():
    import pathlib
    import textwrap as module

    root = pathlib.Path(module.__file__).parent
    n = 0
    for p in sorted(root.glob("*.py"))[:40]:
        for _, _, _, f in functions(p.read_text()):
            n += 1
            assert loads(dumps(f)) == f
    assert n > 300


@pytest.mark.parametrize("source", ["def f(:", "def f():\n  return 1\n bad"])
def test_bad_sources_fail_to_parse(source):
    with pytest.raises(SyntaxError):
        functions(source)


def test_one_step_of_an_iterator_is_lifted():
    from gleanery.functions.rewrite import lift_step

    found = lambda v, back=None: sequence([Form("traverse", back, (Form("free", 0), Form("branch", None, (Form("method", "ok", (local(1),)), Form("return", None, (Form("variant", "Some", (v,)),))))), (bind(1),)), Form("variant", "None")])
    assert str(lift_step(found(local(1)))) == "(retain f0 v1 (method ok v1))"
    assert lift_step(found(Form("method", "get", (local(1),)))).tag == "sift"
    assert lift_step(found(local(1), "back")) is None and lift_step(Form("lit")) is None


def test_work_is_going_through_a_sequence_and_decisions_have_two_names():
    from gleanery.functions.forms import describes_decision, describes_work

    chain = Form("local", 0)
    for n in ("a", "b", "c", "d", "e"):
        chain = Form("method", n, (chain,))
    assert metrics(chain)["anchors"] == 5 and not describes_work(chain) and not is_reportable(chain)
    arm = lambda name: Pattern("variant", name)
    body = Form("method", "go", (Form("local", 0),))
    two = Form("select", None, (Form("local", 0), body, body), (arm("A"), arm("B")))
    same = Form("select", None, (Form("local", 0), body, body), (arm("A"), arm("A")))
    assert describes_decision(two) and is_reportable(two) and not describes_decision(same) and not is_reportable(same)
    assert [r[-1] for r in node_rows(two)][0] and not [r[-1] for r in node_rows(same)][0]


def test_folds_from_a_unit_are_walks():
    from gleanery.functions.rewrite import traversal

    item, acc, body = Pattern("bind", 1), Pattern("bind", 0), Form("method", "go", (Form("local", 1),))
    for name in ("fold", "try_fold", "try_for_each"):
        for pats in ((acc, item), (item,)):
            got = traversal(Form("method", name, (Form("free", 0), UNIT, Form("lambda", None, (body,), pats))))
            assert got == Form("traverse", None, (Form("free", 0), body), (item,))
        assert traversal(Form("method", name, (Form("free", 0), Form("num", "1"), Form("lambda", None, (body,), (item,))))) is None
    assert traversal(Form("method", "for_each", (Form("free", 0), Form("lambda", None, (body,), (item,))))) is None


def test_lambdas_that_name_each_other_stay():
    from gleanery.functions.rewrite import unfold

    call = lambda n: Form("call", None, (Form("local", n), Form("local", 9)))
    let = lambda n, m: Form("let", None, (Form("lambda", None, (call(m),), (Pattern("bind", 8),)),), (Pattern("bind", n),))
    form, fuel = Form("do", None, (let(1, 2), let(2, 1), call(1))), [16]
    assert unfold(form, fuel) == form and fuel == [16]
