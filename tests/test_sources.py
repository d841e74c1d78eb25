"""Extraction from source text, on literal files of our own."""

from __future__ import annotations

import pytest

from edgeframe.operators import resolve
from edgeframe.sources import typescript

FILES = {
    "src/main.ts": """
import { helper, Service as Svc } from './lib';
import fallback from './lib/fallback';
import * as ns from "./lib";
// helper() in a comment
export async function main(name: string, n?: number, deep = { a: 1 }): Promise<void> {
  const s = new Svc(helper(name));
  await s.run(1, 'x', () => helper('inner'));
  if (n) { fallback(); } else again();
  items.map(helper);
  s['stop']();
}
function again() { again(); for (const x of xs) { helper(x); } }
export const arrow = (x: number): number => twice(x);
const twice = async function (x) { return x * 2; };
""",
    "src/lib/index.ts": "export * from './service';\nexport { helper } from './helper';\n",
    "src/lib/helper.ts": "export function helper(x) { return `t ${x}`; }\n",
    "src/lib/fallback.ts": "export default function fallback(...rest: string[]) { }\n",
    "src/lib/service.ts": """
@Injectable()
export class Service extends Base {
  private log: Logger;
  static made = 0;
  constructor(private db: Db, x) { super(x); this.start(); }
  get size(): number { return 1; }
  async run(a: number): Promise<Map<string, number>> { return cond ? this.start() : Service.make(); }
  protected start() { this.log.write('x'); }
  static make(): Service { return new Service(null, 1); }
  stop = async () => { this.start(); };
  handler(): void {}
}
class Logger { write(m: string) {} }
""",
}


@pytest.fixture(scope="module")
def facts(spark):
    return typescript.extract(spark.createDataFrame(list(FILES.items()), "path string, content string")).persist()


def test_functions(facts):
    nodes = {r.id: r for r in resolve.function_nodes(facts).collect()}
    named = {i for i, r in nodes.items() if r.name != "anonymous"}
    assert named == {
        "src/main.ts#main", "src/main.ts#again", "src/main.ts#arrow", "src/main.ts#twice", "src/lib/helper.ts#helper", "src/lib/fallback.ts#fallback",
        "src/lib/service.ts#Service.constructor", "src/lib/service.ts#Service.get:size", "src/lib/service.ts#Service.run", "src/lib/service.ts#Service.start",
        "src/lib/service.ts#Service.make", "src/lib/service.ts#Service.stop", "src/lib/service.ts#Service.handler", "src/lib/service.ts#Logger.write",
    }
    assert len(nodes) == len(named) + 1
    main = nodes["src/main.ts#main"]
    assert main.is_async and main.return_type == "Promise<void>" and main.line == 6
    assert [(p.name, p.type, p.optional, p.default_value) for p in main.parameters] == [("name", "string", False, None), ("n", "number", True, None), ("deep", "unknown", True, "{a:1}")]
    assert nodes["src/lib/service.ts#Service.start"].visibility == "protected"
    assert nodes["src/lib/service.ts#Service.make"].is_static and nodes["src/lib/service.ts#Service.get:size"].type == "accessor"
    assert nodes["src/lib/service.ts#Service.run"].return_type == "Promise<Map<string,number>>"


def test_edges(facts):
    edges = resolve.call_edges(facts, attribution="innermost", callbacks=False).collect()
    short = lambda i: i.split("#")[1]
    found = {(short(e.src) if not short(e.src).isdigit() else "callback", short(e.dst), e.type, e.conditional) for e in edges}
    assert found == {
        ("main", "Service.constructor", "constructor", False),
        ("main", "helper", "callback", False),
        ("main", "Service.run", "async", False),
        ("callback", "helper", "sync", False),
        ("main", "fallback", "sync", True),
        ("main", "again", "sync", True),
        ("main", "Service.stop", "async", False),
        ("again", "again", "sync", False),
        ("again", "helper", "sync", True),
        ("arrow", "twice", "async", False),
        ("Service.constructor", "Service.start", "sync", False),
        ("Service.run", "Service.start", "sync", True),
        ("Service.run", "Service.make", "sync", True),
        ("Service.start", "Logger.write", "sync", False),
        ("Service.make", "Service.constructor", "constructor", False),
        ("Service.stop", "Service.start", "sync", False),
    }


def test_imports_off_and_attribution(facts):
    alone = resolve.call_edges(facts, follow_imports=False, callbacks=False).collect()
    assert not any("lib/helper" in e.dst for e in alone)
    both = resolve.call_edges(facts)
    assert both.filter("type = 'callback' and src like '%#main'").count() >= 1
    assert both.filter("dst like '%#helper' and src like '%#main'").count() == 2  # its own and its callback's


def test_empty_and_broken_files(spark):
    table = spark.createDataFrame([("a.ts", None), ("b.ts", ""), ("c.ts", "function ( { [ ) class"), ("d.ts", "x".join("({["))], "path string, content string")
    assert typescript.extract(table).filter("path in ('a.ts', 'b.ts')").count() == 0
