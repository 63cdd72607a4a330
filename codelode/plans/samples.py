"""One small source per language with definition types, and the definitions each must give."""

from __future__ import annotations

#: Language to a source file.
SOURCES = {
    "python": """\
\"\"\"Doc.\"\"\"
import os

# c
X = [
1,
]
@dec(1)
@other
def f(a):
    return \"\"\"
class not:
\"\"\"

class A(B):
    def m(self):
        pass

async def g(): pass
if X:
    y = 1
else:
    y = 2
""",
    "javascript": """\
import a from "b";
/** x */
export function e() { return 1 }
async function f(a) {
  return `}`
}
class A extends B {
  m() {}
}
const x = (a) => {
  return 1
}
function* gen() {}
if (a) {
 b()
} else {
 c()
}
var r = /[}"]/g;
function h() {}
""",
    "typescript": """\
import a from "b";
export class E {}
function over(a: string): void;
function over(a: any): void { }
interface I<T> extends J {
  a: string
}
type U = A |
  B;
enum C { A }
const enum D { A }
abstract class Z {}
@Dec()
class K {}
""",
    "tsx": """\
enum C { A }
function App() {
  return <div>{a}</div>;
}
interface P { a: number }
""",
    "go": """\
package a

import (
 "b"
)

var x = 3

func (c *T) F(a int) error {
  return nil
}

func G[T any](a T) {
}
type S struct {
 A int
}
type (
 A int
)
type X = int
""",
    "rust": """\
use a::b;
#[derive(Debug)]
pub struct S<'a> { x: &'a str }
pub(crate) async fn f(a: u8) -> u8 { '{' }
impl<T> Tr for S<T> {
 fn m() {}
}
impl S { }
enum E { A }
pub trait Q { fn a(); }
type T2 = u8;
mod m { fn z() {} }
struct U;
macro_rules! x { () => {} }
""",
    "java": """\
package a;
import b.C;
@A(x = 1)
public class Foo<T> extends B {
  void m() {}
}
interface I { }
enum E { A }
record R(int a) {}
public static int f(List<String> a) throws X {
  return 1;
}
Foo(int a) { }
""",
    "c": """\
#include <a.h>
#define X(a) \\
  {
static int x[] = { 1 };
struct S {
 int a;
};
struct S v = { 1 };
static void *f(const char *a)
{
  return 0;
}
int proto(int);
enum E { A };
typedef struct { int a; } T;
struct Q { int a; } q;
""",
    "cpp": """\
namespace n {
int f() { return 1; }
}
class A : public B {
 public:
  int m();
};
int A::m() { return 1; }
template <class T> T g(T a) { return a; }
enum class E { A };
std::vector<int> h(int a) {
}
A::~A() {}
""",
    "ruby": """\
require "a"
# c
class A < B
  def m
    if x then y end
  end
end

def f(a)
  a.each do |x|
  end
end
module M
end
def self.g; end
def h(a) = a + 1
puts 1
""",
    "php": """\
<?php
namespace A;
use B;
function f($a) {
  return "}";
}
final class C extends D {
  public function m() {}
}
interface I {}
$x = 1;
""",
    "swift": """\
import A
public func f(a: Int) -> Int {
  return a
}
class B: C {
}
struct S { }
extension S {
}
protocol P {}
let x = 1
@main
struct App {}
""",
    "kotlin": """\
package a
import b.C
data class P(val a: Int)
fun f(a: Int): Int {
  return a
}
fun String.g() = 1
object O {
}
interface I
val x = 1
enum class E { A }
class Z @Inject constructor(a: Int) : B() {
}
""",
    "scala": """\
package a
import b._
case class P(a: Int)
object O {
  def m = 1
}
trait T
def f(a: Int): Int = {
  a
}
val x = 1
""",
    "c_sharp": """\
using A;
namespace N;
[Serializable]
public class B : C {
  void M() {}
}
public interface I {}
enum E { A }
record R(int A);
""",
    "lua": """\
local a = require("b")
-- c
local function f(x)
  if x then
    return 1
  end
end

function M.g(a)
end
function M:h() return 1 end
return M
""",
}

#: Language to ``(symbol, start_line, end_line)`` of its definitions, in order.
EXPECTED = {
    "python": [("f", 8, 13), ("A", 15, 17), ("g", 19, 19)],
    "javascript": [("f", 4, 6), ("A", 7, 9), ("h", 20, 20)],
    "typescript": [("over", 4, 4), ("I", 5, 7), ("U", 8, 9), ("C", 10, 10), ("D", 11, 11), ("K", 13, 14)],
    "tsx": [("App", 2, 4), ("P", 5, 5)],
    "go": [("F", 9, 11), ("G", 13, 14), ("S", 15, 17), ("<anonymous>", 18, 20), ("X", 21, 21)],
    "rust": [("S", 3, 3), ("f", 4, 4), ("S", 5, 7), ("S", 8, 8), ("E", 9, 9), ("Q", 10, 10), ("T2", 11, 11), ("U", 13, 13)],
    "java": [("Foo", 3, 6), ("I", 7, 7), ("E", 8, 8), ("f", 10, 12), ("Foo", 13, 13)],
    "c": [("S", 5, 7), ("f", 9, 12), ("E", 14, 14)],
    "cpp": [("n", 1, 3), ("A", 4, 7), ("A::m", 8, 8), ("E", 10, 10), ("h", 11, 12), ("~A", 13, 13)],
    "ruby": [("A", 3, 7), ("f", 9, 12), ("M", 13, 14), ("self.g", 15, 15), ("h", 16, 16)],
    "php": [("f", 4, 6), ("C", 7, 9)],
    "swift": [("f", 2, 4), ("B", 5, 6), ("S", 7, 7), ("S", 8, 9), ("P", 10, 10), ("App", 12, 13)],
    "kotlin": [("P", 3, 3), ("f", 4, 6), ("g", 7, 7), ("O", 8, 9), ("I", 10, 10), ("E", 12, 12), ("Z", 13, 14)],
    "scala": [("P", 3, 3), ("O", 4, 6), ("T", 7, 7), ("f", 8, 10)],
    "c_sharp": [("B", 3, 6), ("I", 7, 7), ("E", 8, 8)],
    "lua": [("f", 3, 7), ("M.g", 9, 10), ("M:h", 11, 11)],
}
