import pytest

from leafmill.operators.formula import Node, SheetError, Workbook, evaluate, index_to_letters, letters_to_index, parse, recalculate, translate


def value(formula, cells=None):
    try:
        got = evaluate(parse(formula), lambda ref: None)
    except SheetError as e:
        return e.code
    return got


@pytest.mark.parametrize(
    "formula, expected",
    [
        ("-2^2", 4), ("2^3^2", 64), ("50%*2", 1), ("ROUND(-2.5,0)", -2), ("ROUNDUP(-1.1,0)", -2), ("ROUNDDOWN(-1.9,0)", -1), ("MOD(-7,3)", 2), ("MOD(7,-3)", -2), ("MOD(1,0)", "#DIV/0!"),
        ("IF(TRUE,1,1/0)", "#DIV/0!"), ('IFERROR(1/0,"x")', "x"), ('SUM("3",4)', 7), ('MID("abc",0,2)', "c"), ('LEFT("abc",-1)', ""), ('RIGHT("abc",9)', "abc"), ('"10"<"9"', True), ('10<"9"', False), ('"A"="a"', True),
        ('LEN("a😀")', 3), ("SQRT(-1)", "#NUM!"), ("nope", "#NAME?"), ("1+", "#PARSE"), ("VLOOKUP(1,2,3)", "UNSUP"), ('1&"a"', "1a"), ('IF("",1)', False), ("1<>2", True), ('5="x"', False), ('5<>"x"', True), ("AND()", True), ("OR()", False),
    ],
)
def test_values(formula, expected):
    assert value(formula) == expected


def cell(row, col=0, raw="", formula=None, sheet=0, name="S"):
    return {"sheet": sheet, "sheet_name": name, "row": row, "col": col, "raw": raw, "kind": None, "formula": formula}


def shown(cells):
    return {k[1:]: v.code if isinstance(v, SheetError) else v for k, v in Workbook(iter(cells)).values().items()}


def test_chains_ranges_cycles_and_unknown_sheets():
    got = shown([cell(0, raw="5"), cell(1, formula="A1*2"), cell(2, formula="SUM(A1:A2)+S!A1"), cell(3, formula="A4"), cell(4, formula="Z!A1"), cell(5, formula="A7"), cell(6, formula="A6"), cell(7, formula='IFERROR(A4,"c")')])
    assert got == {(1, 0): 10, (2, 0): 20, (3, 0): "#CIRC!", (4, 0): "#REF!", (5, 0): "#CIRC!", (6, 0): "#CIRC!", (7, 0): "c"}


def test_blank_ranges_and_conditions():
    cells = [cell(0, raw=""), cell(1, raw="5"), cell(2, raw="7"), cell(3, raw="a*"), cell(4, raw="ab")]
    got = shown([*cells, cell(0, 1, formula='COUNTIF(A1:A3,">=5")'), cell(1, 1, formula='COUNTIF(A4:A5,"a*")'), cell(2, 1, formula="MAX(A1:A1)"), cell(3, 1, formula="AVERAGE(A1:A1)"), cell(4, 1, formula='SUMIF(A1:A3,">5")'), cell(5, 1, formula="SUM(A1:Z10000)")])
    assert got == {(0, 1): 2, (1, 1): 1, (2, 1): 0, (3, 1): "#DIV/0!", (4, 1): 7, (5, 1): "#NUM!"}


def test_long_chain_does_not_recurse():
    n = 5000
    got = shown([cell(0, raw="1"), *[cell(i, formula=f"A{i}+1") for i in range(1, n)]])
    assert got[n - 1, 0] == n


def test_translate():
    assert translate('SUM($A1,B$2,"A1")&C3', 1, 1) == 'SUM($A2,C$2,"A1")&D4'
    assert translate("A1", -5, -5) == "A1"


def test_letters():
    assert [index_to_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(letters_to_index(index_to_letters(i)) == i for i in range(0, 18000, 7))


def test_precedence_tree():
    node = parse("1+2*3")
    assert isinstance(node, Node) and node.op == "+" and node.args[1].op == "*"


def test_recalculate_in_spark(spark):
    rows = [("b", 0, "S", 0, 0, "2", None, None), ("b", 0, "S", 1, 0, None, None, "A1^3"), ("b", 0, "S", 2, 0, "old", None, "VLOOKUP(1,A1:A2,1)"), ("c", 0, "S", 0, 0, None, None, "1/0")]
    df = spark.createDataFrame(rows, "book string, sheet int, sheet_name string, row int, col int, raw string, kind string, formula string")
    got = {(r.book, r.row): (r.kind, r.num, r.error) for r in recalculate(df).collect()}
    assert got == {("b", 1): ("num", 8.0, None), ("c", 0): ("error", None, "#DIV/0!")}
    assert recalculate(df.where("false")).count() == 0
