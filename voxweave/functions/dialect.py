"""The few places where Spark SQL and the SQL of the checking engine differ, so that each operator is written once."""

from __future__ import annotations


class Spark:
    name = "spark"

    def table(self, name: str, sf_dir: str) -> str:
        return f"parquet.`{sf_dir}/{name}.parquet`"

    def array(self, items) -> str:
        return "array(" + ", ".join(lit(x) for x in items) + ")"

    def at(self, array: str, i: str) -> str:
        return f"element_at({array}, cast({i} as int))"

    def div(self, a: str, b) -> str:
        return f"(({a}) div {b})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', r'{by.replace(chr(92), '$')}')"

    def find(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')"

    def chars(self, x: str) -> str:
        return f"filter(split({x}, ''), c -> c <> '')"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, r'{sep}')"

    def cp(self, c: str) -> str:
        return f"ascii({c})"

    def chr(self, n: str) -> str:
        return f"decode(unhex(concat('0000FEFF', lpad(hex(cast({n} as bigint)), 8, '0'))), 'UTF-32')"  # the mark of byte order goes first, so U+FEFF itself stays

    def map(self, array: str, v: str, e: str) -> str:
        return f"transform({array}, {v} -> {e})"

    def keep(self, array: str, v: str, e: str) -> str:
        return f"filter({array}, {v} -> {e})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def explode(self, array: str, columns: str, source: str, index: str = "i", item: str = "x") -> str:
        return f"select {columns}, cast({index} as bigint) {index}, {item} from (select *, posexplode({array}) as ({index}, {item}) from {source})"

    def range(self, n: int) -> str:
        return f"(select cast(id as bigint) id from range({n}))"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def upto(self, n: str) -> str:
        """1 to n, where n is at least 1."""
        return f"sequence(1, cast({n} as int))"

    def list(self, *items: str) -> str:
        return "array(" + ", ".join(items) + ")"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def let(self, v: str, x: str, e: str) -> str:
        """e with v standing for x, which is worked out once."""
        return f"element_at({self.map(f'array({x})', v, e)}, 1)"


class Check(Spark):
    name = "check"

    def table(self, name: str, sf_dir: str) -> str:
        return name

    def array(self, items) -> str:
        return "[" + ", ".join(lit(x) for x in items) + "]"

    def at(self, array: str, i: str) -> str:
        return f"list_extract({array}, cast({i} as int))"

    def div(self, a: str, b) -> str:
        return f"(({a}) // {b})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def find(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, '{pattern}')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def chars(self, x: str) -> str:
        return f"list_filter(string_split({x}, ''), lambda c: c <> '')"

    def split(self, x: str, sep: str) -> str:
        return f"string_split_regex({x}, '{sep}')"

    def cp(self, c: str) -> str:
        return f"unicode({c})"

    def chr(self, n: str) -> str:
        return f"chr(cast({n} as int))"

    def map(self, array: str, v: str, e: str) -> str:
        return f"list_transform({array}, lambda {v}: {e})"

    def keep(self, array: str, v: str, e: str) -> str:
        return f"list_filter({array}, lambda {v}: {e})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def size(self, array: str) -> str:
        return f"cast(len({array}) as bigint)"

    def bytes(self, x: str) -> str:
        return f"cast(strlen({x}) as bigint)"

    def explode(self, array: str, columns: str, source: str, index: str = "i", item: str = "x") -> str:
        return f"select {columns}, cast(unnest(range(len(_a))) as bigint) {index}, unnest(_a) {item} from (select *, {array} _a from {source})"

    def range(self, n: int) -> str:
        return f"(select range id from range({n}))"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def upto(self, n: str) -> str:
        return f"range(1, {n} + 1)"

    def list(self, *items: str) -> str:
        return "[" + ", ".join(items) + "]"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + "}"

    def let(self, v: str, x: str, e: str) -> str:
        return f"list_extract({self.map(f'[{x}]', v, e)}, 1)"


def lit(x) -> str:
    return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


SPARK, CHECK = Spark(), Check()
