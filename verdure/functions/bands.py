"""Band expressions as Columns: arithmetic, comparisons, logic and reducers over b1..bN.

Text is parsed into Python's syntax tree and checked against a small list of allowed nodes; nothing is evaluated in
Python. Two modes: ``zero`` maps missing and infinite inputs and results to 0 and divides by zero to 0; ``preserve``
knows names and operators only and gives NULL for missing, infinite and undefined values.
"""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS = {"sum": "sum", "mean": "avg", "avg": "avg", "min": "min", "max": "max", "std": "stddev_pop", "median": "median"}
PIXELWISE = {"psum": "sum", "pmean": "mean", "pmin": "min", "pmax": "max", "pstd": "std", "pmedian": "median"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "!="}

#: The named expressions that a training table offers by default.
DEFAULT_EXPRESSIONS = {
    "boolean1": "b1 > 150",
    "boolean2": "(b1 > 150) & (b2 > 165)",
    "boolean3": "(b2 / (b1 + b2 + b3)) > 0.41",
    "sum": "b1 + b2 + b3",
    "GCC": "b2 / (b1 + b2 + b3)",
    "EXG": "2*b2 - (b1 + b3)",
    "RCC": "b3 / (b1 + b2 + b3)",
    "BCC": "b1 / (b1 + b2 + b3)",
    "WDX_2": "(2*b1) + b3 - (2*b2)",
    "WDX": "b1 + 2*b1 - b2",
    "WDX_3": "b1 + 2*b3 - 2*b2",
}


class Unknown(ValueError):
    """A band or function that is not there."""


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def _words(text: str) -> str:
    for word, sign in (("AND", "&"), ("OR", "|"), ("NOT", "~")):
        text = re.sub(rf"\b{word}\b", sign, text, flags=re.I)
    return text.strip()


class _Builder:
    def __init__(self, bands: dict[str, Column], mode: str):
        self.bands, self.mode = bands, mode
        self.aggregates: dict[str, Column] = {}

    def number(self, c: Column, logical: bool) -> Column:
        return c.cast("double") if logical else c

    def truth(self, c: Column, logical: bool) -> Column:
        return c if logical else c != 0

    def visit(self, node) -> tuple[Column, bool]:
        """The node's Column, and whether it is a truth value."""
        if isinstance(node, ast.Expression):
            return self.visit(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value)), False
        if isinstance(node, ast.Name):
            name = node.id.lower()
            if name not in self.bands:
                raise Unknown(f"unknown name {node.id!r}; use one of {', '.join(self.bands)}")
            return self.bands[name], False
        if isinstance(node, ast.UnaryOp):
            c, logical = self.visit(node.operand)
            if isinstance(node.op, ast.Invert):
                return ~self.truth(c, logical), True
            if isinstance(node.op, (ast.USub, ast.UAdd)):
                return (-self.number(c, logical) if isinstance(node.op, ast.USub) else self.number(c, logical)), False
        if isinstance(node, ast.BinOp):
            (a, la), (b, lb) = self.visit(node.left), self.visit(node.right)
            if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
                a, b = self.truth(a, la), self.truth(b, lb)
                return (a & b if isinstance(node.op, ast.BitAnd) else a | b), True
            a, b = self.number(a, la), self.number(b, lb)
            if isinstance(node.op, ast.Add):
                return a + b, False
            if isinstance(node.op, ast.Sub):
                return a - b, False
            if isinstance(node.op, ast.Mult):
                return a * b, False
            if isinstance(node.op, ast.Div):
                return (F.when(b != 0, F.try_divide(a, b)).otherwise(F.lit(0.0)) if self.mode == "zero" else F.try_divide(a, b)), False
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1:
                raise ValueError("put comparisons in parentheses before combining them")
            (a, la), (b, lb) = self.visit(node.left), self.visit(node.comparators[0])
            sign = _COMPARE.get(type(node.ops[0]))
            if sign:
                a, b = self.number(a, la), self.number(b, lb)
                return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "!=": a != b}[sign], True
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and self.mode == "zero":
            return self.call(node.func.id.lower(), node.args)
        raise ValueError(f"not allowed in a band expression: {ast.unparse(node) if isinstance(node, ast.AST) else node}")

    def call(self, name: str, args) -> tuple[Column, bool]:
        if name in REDUCERS and len(args) == 1:
            inner = _Builder(self.bands, self.mode)
            c, logical = inner.visit(args[0])
            if inner.aggregates:
                raise ValueError("a whole-image reducer may not hold another one")
            alias = f"__{name}_{len(self.aggregates)}_{abs(hash(ast.dump(args[0]))) % 10**8}"
            c = self.number(c, logical)
            self.aggregates[alias] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_pop": F.stddev_pop, "median": F.median}[REDUCERS[name]](c).alias(alias)
            return F.col(alias), False
        got = [self.visit(a) for a in args]
        nums = [self.number(c, logical) for c, logical in got]
        kind = PIXELWISE.get(name) or (REDUCERS.get(name) and {"avg": "mean"}.get(name, name))
        if kind and nums:
            return _across(kind, nums), False
        if name == "clip" and len(nums) == 3:
            return F.greatest(nums[1], F.least(nums[2], nums[0])), False
        if name == "where" and len(nums) == 3:
            return F.when(self.truth(*got[0]), nums[1]).otherwise(nums[2]), False
        one = {"abs": F.abs, "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "log": lambda x: F.log(F.greatest(x, F.lit(1e-12))), "exp": F.exp}.get(name)
        if one and len(nums) == 1:
            return one(nums[0]), False
        raise Unknown(f"unknown function {name!r} of {len(nums)} arguments")


def _across(kind: str, cols: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, cols)
    n = len(cols)
    if kind == "sum":
        return total
    if kind == "mean":
        return total / n
    if kind in ("min", "max"):
        return cols[0] if n == 1 else (F.least(*cols) if kind == "min" else F.greatest(*cols))
    if kind == "std":
        mean = total / n
        return F.sqrt(reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / n)
    ordered = F.sort_array(F.array(*cols))
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def parse(text: str, bands: list[str], mode: str = "zero") -> tuple[Column, dict[str, Column]]:
    """The expression's Column, and the whole-image aggregates that it needs by name."""
    if mode not in ("zero", "preserve"):
        raise ValueError("mode is zero or preserve")
    clean = {b: F.coalesce(finite(F.col(b)), F.lit(0.0)) if mode == "zero" else finite(F.col(b)) for b in bands}
    builder = _Builder(clean, mode)
    c, logical = builder.visit(ast.parse(_words(text), mode="eval"))
    c = finite(builder.number(c, logical))
    return (F.coalesce(c, F.lit(0.0)) if mode == "zero" else c), builder.aggregates


def evaluate(pixels: DataFrame, expressions: dict[str, str], mode: str = "zero", bands: list[str] | None = None, image: str = "image_id", strict: bool = True) -> DataFrame:
    """pixels with a column per named expression, all in one projection.

    Whole-image reducers are one aggregation by image, joined back; without them the plan has no shuffle. With
    ``strict=False`` an expression that cannot be parsed is left out."""
    bands = bands or [c for c in pixels.columns if re.fullmatch(r"b\d+", c)]
    out, aggregates = {}, {}
    for name, text in expressions.items():
        try:
            out[name], more = parse(text, bands, mode)
            aggregates.update(more)
        except (ValueError, SyntaxError):
            if strict:
                raise
    rows = pixels
    if aggregates:
        rows = pixels.join(pixels.groupBy(image).agg(*aggregates.values()), image)
    return rows.withColumns(out).drop(*aggregates) if out else rows


def parse_formulas(text: str) -> dict[str, str]:
    """Formulas given as JSON, or as lines of name=expression; lines without a sign are skipped."""
    import json

    try:
        given = json.loads(text)
        return {str(k): str(v) for k, v in given.items()} if isinstance(given, dict) else {}
    except ValueError:
        pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.strip().startswith("#"))
        return {k.strip(): v.strip() for k, v in pairs if k.strip() and v.strip()}


def display_bytes(pixels: DataFrame, expression: str, out: str = "band", image: str = "image_id") -> DataFrame:
    """An expression scaled to 0..255 between its image's least and greatest value; 128 where these are equal."""
    rows = evaluate(pixels, {"__v": expression}, "preserve", image=image)
    ends = rows.groupBy(image).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    rows = rows.join(ends, image)
    scaled = F.when(F.col("__lo") == F.col("__hi"), F.lit(128)).otherwise(F.floor((F.col("__v") - F.col("__lo")) * 255 / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))).cast("int"))
    return rows.withColumn(out, scaled).drop("__v", "__lo", "__hi")


def _share(part: Column, total: Column) -> Column:
    return part / F.when(total == 0, F.lit(1.0)).otherwise(total)


def exg(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - (r + b)


def gcc(r: Column, g: Column, b: Column) -> Column:
    return _share(g, r + g + b)


def bcc(r: Column, g: Column, b: Column) -> Column:
    return _share(b, r + g + b)


def rcc(r: Column, g: Column, b: Column) -> Column:
    return _share(r, r + g + b)


def gbd(g: Column, b: Column) -> Column:
    return _share(g - b, g + b)


def wdx(r: Column, g: Column, b: Column) -> Column:
    return 2 * b + r - 2 * g


def shd(r: Column, g: Column, b: Column) -> Column:
    return r + g + b


# --- NoData -------------------------------------------------------------------------------------------------------

_RULE = re.compile(r"^\s*b(\d+)\s*(<=|>=|==|!=|<|>)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$", re.I)


def parse_nodata(text: str) -> list[float | str]:
    """Numbers and band rules of a user's text, in order, without repeats. Braces and brackets are allowed."""
    out: list[float | str] = []
    for part in re.split(r"[,;\n]+", re.sub(r"[{}\[\]()]", " ", text or "")):
        part = part.strip()
        if not part:
            continue
        value: float | str
        if _RULE.match(part):
            value = re.sub(r"\s+", "", part.lower())
        else:
            try:
                value = float(part)
            except ValueError:
                continue
        if value not in out:
            out.append(value)
    return out


def tolerance(value: float) -> float:
    size = abs(value)
    return size * 0.01 if size > 1e30 else size * 0.001 if size > 100 else 0.01


def is_nodata(spec: list[float | str], bands: list[str]) -> Column:
    """Whether a pixel is missing: a band near a literal, a rule on its band, or a missing or infinite value.

    Without a spec nothing is missing; rules on bands that are not there are left out."""
    if not spec:
        return F.lit(False)
    tests = [finite(F.col(b)).isNull() for b in bands]
    for item in spec:
        if isinstance(item, str):
            m = _RULE.match(item)
            if not m or f"b{int(m[1])}" not in bands:
                continue
            c, op, v = F.col(f"b{int(m[1])}"), m[2], float(m[3])
            near = F.abs(c - v) <= 1e-6
            tests.append({"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "==": near, "!=": ~near}[op])
        else:
            tests += [F.abs(F.col(b) - item) <= tolerance(item) for b in bands]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def mask_missing(pixels: DataFrame, spec: list[float | str], bands: list[str]) -> DataFrame:
    """Literal matches, NaN and infinities become NULL, band by band."""
    values = [v for v in spec if not isinstance(v, str)]
    clean = {b: reduce(lambda c, v, b=b: F.when(~(F.abs(F.col(b) - v) <= tolerance(v)), c), values, finite(F.col(b))) for b in bands}
    return pixels.withColumns(clean)


def apply_masked(expression: Column, keep: Column, masked: Column) -> Column:
    """The expression where the pixel is not masked, the kept value where it is."""
    return F.when(masked, keep).otherwise(expression)


def export_order(n_bands: int) -> list[str]:
    """Bands as stored (blue, green, red, ...) in the order in which users see them."""
    order = list(range(1, n_bands + 1))
    if n_bands >= 3:
        order[:3] = [3, 2, 1]
    return [f"b{i}" for i in order]


def append_band(pixels: DataFrame, value: Column) -> DataFrame:
    """pixels with the value as one more band."""
    last = max([int(c[1:]) for c in pixels.columns if re.fullmatch(r"b\d+", c)], default=0)
    return pixels.withColumn(f"b{last + 1}", value)
