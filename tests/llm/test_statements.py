import pytest

from sparquill.llm.statements import canonical

BASE = "SELECT p.name, p.id FROM products p JOIN order_items oi ON oi.product_id = p.id WHERE p.price >= 5.50 AND p.brand = 'Zephrix'"


@pytest.mark.parametrize(
    "other",
    [
        "select p.id , p.name from products p\n join order_items oi on (oi.product_id=p.id) where (p.brand='zephrix') and ((p.price)>=5.50);",
        'SELECT "p"."name",`p`."id"  FROM products p JOIN order_items oi\tON oi.product_id = p.id WHERE p.brand = \'ZEPHRIX\' AND p.price >= 5.50 ;;\n',
        f"  ({BASE}) ",
    ],
)
def test_formatting_makes_no_difference(other):
    assert canonical(other) == canonical(BASE)


@pytest.mark.parametrize("old,new", [(">=", ">"), ("5.50", "5.5"), ("'Zephrix'", "'Zephri'"), ("oi.product_id = p.id", "p.id = oi.product_id"), ("p.id FROM", "p.ids FROM"), ("AND", "OR")])
def test_other_differences_count(old, new):
    assert canonical(BASE.replace(old, new, 1)) != canonical(BASE)


def test_literals_and_nesting_are_no_places_to_reorder():
    assert canonical("select a from t where x = 'b and a'") != canonical("select a from t where x = 'a and b'")
    assert canonical("select f(a, b) from t") != canonical("select f(b, a) from t")
    assert canonical("select f(a, b), c from t") == canonical("select c, f(a, b) from t")
    assert canonical("select a from t where x between 1 and 2 and y between 3 and 4") != canonical("select a from t where x between 1 and 4 and y between 3 and 2")
    assert canonical("select a from t where x between 1 and 2 and y = 3") == canonical("select a from t where y=3 and x between 1 and 2")
    assert canonical("select a from (select b, c from u where p=1 and q=2) s") == canonical("select a from (select c, b from u where q=2 and p=1) s")


def where(condition):
    return canonical(f"select a from t where {condition}")


def test_conditions_move_between_ands_only():
    assert where("a=1 and b=2 or c=3") != where("b=2 or c=3 and a=1")
    assert where("a=1 and b=2 or c=3") == where("b=2 and a=1 or c=3") == where("(b=2 and a=1) or c=3")
    assert where("a=1 and (b=2 or c=3)") == where("((b=2) or c=3) and a=1")
    assert where("(c=3 and a=1) and b=2") == where("a=1 and b=2 and (c=3)")
    assert where("x between 1 and 2 or b=2 and a=1") == where("x between (1) and (2) or a=1 and b=2")
    assert where("f(a, b) = 1 and not (c=2 and b=3)") == where("not (b=3 and c=2) and f(a, b) = 1")
    assert where("a in (select b from u where c=1 and d=2) and e=3") == where("a in (select b from u where d=2 and c=1) and e=3")


def test_quotes_inside_literals_count():
    assert where("x = 'x\'\'\'") != where("x = 'x'")
    assert where("x = ''") != where("x = ''''")
    assert where("x = 'a  B'") == where("x = 'A b'")


@pytest.mark.parametrize("text", ["", "  ", ";", "()", "'", "'open", "select", "and and", "where", "€ ☃", "x" * 100_000])
def test_odd_texts(text):
    assert isinstance(canonical(text), str)
    assert canonical(canonical(text)) == canonical(text)
