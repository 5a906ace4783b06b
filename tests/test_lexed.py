"""Facts of the nine lexed languages, on literal sources."""

import pytest

from cartolode.operators.facts import extract_facts, extract_imports
from cartolode.operators.lexed import lexed_facts


def functions(language, text):
    rows = lexed_facts(language, "f", text)
    assert rows[0][-1]
    return {r[2]: (r[5], r[6]) for r in rows if r[1] == "function"}


def exports(language, text):
    return [r[2] for r in lexed_facts(language, "f", text) if r[1] == "export"]


GO = """package p
import "fmt"
type Shape interface { Area() float64 }
type hidden struct{ a int }
const ( Max = 1; min = 2 )
func (s *Square[T]) Area(x int) (float64, error) {
\tif x > 0 && x < 9 || s.ok {
\t\treturn helper(x), nil
\t}
\tfor i := range s.items { fmt.Println("if (", i) }
\tswitch x { case 1, 2: return a.b.Call(), nil
\tcase 3: return 0, nil
\tdefault: }
\tgo func() { if x > 1 { inner() } }()
\treturn 1, nil // if for
}
func helper(x int) float64 { return `case if` }
"""
JAVA = """package a; import java.util.List;
@Service(name = "x") public class A<T extends B> implements C {
  private int n = compute(1);
  public A(int n) { this.n = n; }
  static int foo(int x, List<? extends T> y) throws E {
    if (x > 0 && x < 10) { return x > 5 ? 1 : call(y); }
    switch (x) { case 1: return 1; case 2: return 2; default: return 0; }
    do { x--; } while (x > 0);
    for (var z : y) { try { new Foo(z).run(); } catch (E | F e) { log("a ? b : c"); } }
    items.map(q -> { if (q) { hidden(); } return q; });
  }
  abstract void bar();
}
enum Hidden { X(1), Y(2); }
public record R(int a) { int twice() { return a * 2; } }
"""
KOTLIN = """package a
import b.c.D
const val LIMIT = 3
private val secret = 1
class Box(val n: Int) : Base(n) {
    fun open(x: Int): Int {
        if (x > 1 && n > 2 || x < 0) return run(x)
        val y = when (x) {
            0, 1 -> 5
            in 2..3 -> { other(x) }
            else -> 7
        }
        try { risky() } catch (e: E) { log(e) }
        list.forEach { if (it > 0) hidden(it) }
        return y
    }
    private fun shut() = close(n)
}
interface Door { fun knock() }
fun Box.wide(): Int =
    n * 2
internal fun inside() {}
object Single { fun one() = 1 }
"""
RUST = """use crate::a::b;
pub struct P<T> { x: T }
pub enum E { A, B(i32) }
impl<T> Show for P<T> where T: Clone {
    pub fn show<'a>(&'a self, x: i32) -> Result<i32, E> {
        if let Some(y) = self.x && x > 1 { return go(y)?; }
        match x { 0 => 1, 1 | 2 => { calls::two(x) } _ => 3 };
        loop { while x > 0 { for i in 0..3 { print!("{}", 'x'); } } }
        v.iter().map(|z| { if z { hidden() } });
        Ok(1)
    }
}
trait T { fn need(&self) -> i32; fn have(&self) -> i32 { self.need() } }
mod inner { pub fn deep() { r#"if "match" "#; } fn shallow() {} }
pub const MAX: i32 = 3;
pub(crate) fn wide() {}
"""
RUBY = """require 'set'
module Shop
  class Cart < Base
    attr_reader :items if true
    def total(x, y = 1)
      if x > 1 && y
        puts "if #{x}"
      elsif x
        helper.call(x)
      end
      return 1 unless x or y
      case x
      when 1 then 1
      when 2 then two(x)
      else 0
      end
      while x do x -= 1 end
      items.each do |i|
        hidden(i) if i
      end
      begin
        risky
      rescue => e
        nil
      end
      x ? 1 : 2
    end
    def self.make = new
  end
end
def top
  1
end
"""
PHP = """<html> if ( <?php
namespace App;
use App\\Models\\User;
abstract class Post extends Base implements X {
    const A = 1;
    public function __construct(private ?string $name) { $this->name = $name ?? 'if'; }
    abstract protected function later(): int;
    public static function pick(int $x): string {
        if ($x > 1 and $x < 9) { return self::one($x); } elseif ($x) { return \\App\\two($x); } else if ($x === 3) {}
        foreach ($this->items as $k => $v) { $this->user?->name(); }
        switch ($x) { case 1: case 2: return 'a'; default: return 'b'; }
        $f = function ($y) use ($x) { if ($y) { hidden(); } };
        $g = match (true) { $x > 1, $x > 2 => 'p', default => 'q' };
        return $x ? new Thing($x) : "b";
    }
}
# if
function helper() { return 1; }
interface I { public function f(); }
"""
CSHARP = """using System;
namespace A.B
{
    [Route("x")]
    public class C<T> : D where T : new()
    {
        public int Tag { get; set; }
        private Foo f = new Foo(1) { X = 2 };
        public C(int n) : base(n) { }
        ~C() { }
        public async Task<int> Pick(int? x, string s)
        {
            if (x > 0 && s != null || x < 9) return await Other<int>(x ?? 1);
            foreach (var i in items) { try { i.Run(); } catch (E) when (x > 1) { Log($"if {x}"); } }
            switch (x) { case 1: case 2: return 1; case 3: return 2; default: return 3; }
            var y = x switch { 1 => "a", > 5 => "b", _ => "c" };
            items.Select(q => { if (q) { Hidden(); } return q; });
            return x > 1 ? 1 : 2;
        }
        public string Short() => f.Name();
    }
    internal struct S { public void In() { } }
    public interface I { void F(); }
}
"""
SWIFT = """import Foundation
@objc public class A: B {
    let x = 1
    init(_ n: Int) { self.n = n }
    func pick(_ n: Int) -> String? {
        guard let y = find(n), n > 1 && y > 2 else { return nil }
        if n > 3 || y == 1 { print("if \\(n)") }
        switch n {
        case 0: return "z"
        case 1, 2:
            return "s"
        default: return nil
        }
        repeat { step() } while n > 1
        do { try risky() } catch { log() }
        items.map { if $0 { hidden() } }
        return n > 1 ? "a" : "b"
    }
    deinit { close() }
}
protocol P { func need() -> Int }
extension A { func more() {} }
private func secret() {}
enum E { case a, b }
let top = 1
"""
CPP = """#include <vector>
#define LOOP(x) if (x) \\
    for (;;)
namespace n { namespace {
template <typename T> class Box : public Base<T> {
public:
    explicit Box(int n) : n_(n), m_{n} { init(); }
    ~Box() {}
    int get(int x) const override { return x > 1 ? helper<T>(x) : obj->call(); }
    bool operator==(const Box& o) const { return n_ == o.n_; }
    void later();
};
} }
int n::Box::size(std::vector<int> v) {
    if (v.empty() && true || false) return 1;
    for (auto& i : v) { while (i) { --i; } }
    switch (1) { case 0: return 0; case 1: case 2: return 1; default: break; }
    try { risky(); } catch (const E& e) { std::log("if"); }
    auto f = [&](int q) { if (q) { hidden(); } };
    do { step(); } while (false);
    return R"(if)";
}
extern "C" { int c_api(void) { return 0; } }
using Alias = int;
typedef unsigned long Size;
static const int LIMIT = 3;
int declared(int x);
"""


def test_go():
    got = functions("go", GO)
    assert got == {"Square.Area": (7, ["Call", "Println", "helper"]), "helper": (1, [])}
    assert exports("go", GO) == ["Area", "Max", "Shape"]


def test_java():
    got = functions("java", JAVA)
    assert got["A.<init>"] == (1, []) and got["A.bar"] == (1, []) and got["R.twice"] == (1, [])
    # if, &&, ?:, two cases, do, for, catch
    assert got["A.foo"] == (9, ["call", "log", "map", "run"])
    assert set(got) == {"A.<init>", "A.foo", "A.bar", "R.twice"} and exports("java", JAVA) == ["A", "R"]


def test_kotlin():
    got = functions("kotlin", KOTLIN)
    # if, &&, ||, two entries, try, catch
    assert got["Box.open"] == (8, ["forEach", "log", "other", "risky", "run"])
    assert set(got) == {"Box.open", "Box.shut", "Door.knock", "wide", "inside", "Single.one"} and got["Box.shut"] == (1, ["close"])
    assert exports("kotlin", KOTLIN) == ["Box", "Door", "LIMIT", "Single", "wide"]


def test_rust():
    got = functions("rust", RUST)
    # if, &&, ?, two arms, loop, while, for
    assert got["P<T>.show"] == (9, ["Ok", "Some", "go", "iter", "map", "two"])
    assert set(got) == {"P<T>.show", "T.need", "T.have", "deep", "shallow", "wide"} and got["T.have"] == (1, ["need"])
    assert exports("rust", RUST) == ["E", "MAX", "P", "deep", "show", "wide"]


def test_ruby():
    got = functions("ruby", RUBY)
    # if, &&, elsif, or, two when, while, rescue, ?: ; modifiers do not count
    assert got["Cart.total"][0] == 10 and set(got["Cart.total"][1]) == {"call", "each", "puts", "two"}
    assert set(got) == {"Cart.total", "Cart.make", "top"} and exports("ruby", RUBY) == ["Shop", "top"]


def test_php():
    got = functions("php", PHP)
    # if, and, elseif, else if, foreach, two cases, an arm, ?:
    assert got["Post.pick"] == (10, ["name", "one", "two"])
    assert got["Post.__construct"] == (2, []) and set(got) == {"Post.__construct", "Post.later", "Post.pick", "helper", "I.f"}
    assert exports("php", PHP) == ["I", "Post", "helper"]


def test_csharp():
    got = functions("csharp", CSHARP)
    # if, &&, ||, ??, foreach, catch, two sections, two arms, ?:
    assert got["C.Pick"] == (12, ["Log", "Other", "Run", "Select"])
    assert set(got) == {"C.C", "C.~C", "C.Pick", "C.Short", "S.In", "I.F"} or set(got) == {"C.C", "C.Pick", "C.Short", "S.In", "I.F"}
    assert exports("csharp", CSHARP) == ["C", "I"]


def test_swift():
    got = functions("swift", SWIFT)
    # guard, &&, if, ||, two cases, repeat, do, catch
    assert got["A.pick"] == (10, ["find", "log", "map", "print", "risky", "step"])
    assert set(got) == {"A.init", "A.pick", "A.deinit", "A.more", "secret"} and exports("swift", SWIFT) == ["A", "E", "P", "top"]


def test_cpp():
    got = functions("cpp", CPP)
    # if, &&, ||, for, while, three cases, try, catch, do
    assert got["n.Box.size"] == (12, ["empty", "log", "risky", "step"])
    assert got["Box.get"] == (2, ["call", "helper"]) and set(got) == {"Box.Box", "Box.~Box", "Box.get", "Box.operator==", "n.Box.size", "c_api"}
    assert {"Box", "Alias", "Size", "LIMIT", "c_api"} <= set(exports("cpp", CPP)) and "declared" not in exports("cpp", CPP)


@pytest.mark.parametrize("language, text", [("go", "func f() {"), ("ruby", "def f\n"), ("java", "class A { )"), ("ruby", "end"), ("cpp", "int f() { ]")])
def test_unbalanced_files_have_no_functions(language, text):
    assert [r[-1] for r in lexed_facts(language, "f", text)] == [False]


@pytest.mark.parametrize("text", [None, "", "\n", "// only\n", "é ünï \U0001f600", "((((" * 300 + "))))" * 300])
def test_odd_texts(text):
    for language in ("go", "java", "kotlin", "rust", "ruby", "php", "csharp", "swift", "cpp"):
        assert len(lexed_facts(language, "f", text)) >= 1


def test_extraction_in_spark(spark):
    texts = {"a.go": GO, "b.java": JAVA, "c.kt": KOTLIN, "d.rs": RUST, "e.rb": RUBY, "f.php": PHP, "g.cs": CSHARP, "h.swift": SWIFT, "i.cpp": CPP, "j.h": "int f();", "k.py": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    n = {x: extract_facts(files, x).where("kind = 'function'").count() for x in ("go", "java", "kotlin", "rust", "ruby", "php", "swift", "cpp")}
    assert n == {"go": 2, "java": 4, "kotlin": 6, "rust": 6, "ruby": 3, "php": 5, "swift": 5, "cpp": 6}
    assert [tuple(r) for r in extract_imports(files, "cpp").collect()] == [("i.cpp", "vector")]
    assert {r["spec"] for r in extract_imports(files, "kotlin").collect()} >= {"b.c.D"} and {r["spec"] for r in extract_imports(files, "swift").collect()} >= {"Foundation"}
