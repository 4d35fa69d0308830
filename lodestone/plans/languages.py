"""Queries: chunks of one small file of each language, by symbol, kind and lines."""

from __future__ import annotations

from lodestone.operators import chunking
from lodestone.plans.registry import register

#: Language, file name, source, and the chunks that it must give: symbol, kind, first and last line.
SAMPLES = [
    ("javascript", "shop.js", '''
import { tax } from "./tax.js";

export const net = (price) => price / 1.2;

export default async function load(url) {
  return (await fetch(url)).json();
}

const label = function (x) { return `${x} }`; };

class Basket extends Base {
  items = [];

  add(item) {
    this.items.push(item);
  }

  static of(...items) { return new Basket(items); }
}

on("close", () => {
  save();
});
''', [("<module>", "module", 2, 2), ("net", "function", 4, 4), ("load", "function", 6, 8), ("label", "function", 10, 10), ("Basket", "class", 12, 14),
      ("Basket.add", "function", 15, 17), ("Basket.of", "function", 19, 20), ("<anonymous>", "function", 22, 24)]),
    ("typescript", "shapes.ts", '''
export interface Shape { area(): number; }

type Side = "left" | "right";

export enum Unit { Metre, Mile }

export const scale = (s: Shape, by: number): Shape => ({ area: () => s.area() * by });

export abstract class Square<T> implements Shape {
  private side: number = 1;
  constructor(side: number) { this.side = side; }
  area(): number {
    return this.side ** 2;
  }
}
''', [("Shape", "type", 2, 2), ("Side", "type", 4, 4), ("Unit", "type", 6, 6), ("scale", "function", 8, 8), ("Square", "class", 10, 11),
      ("Square.constructor", "function", 12, 12), ("Square.area", "function", 13, 16)]),
    ("tsx", "panel.tsx", '''
interface Props { title: string; }

export const Panel = ({ title }: Props) => <section>{title}</section>;

function Page() {
  return <Panel title="it's here" />;
}
''', [("Props", "type", 2, 2), ("Panel", "function", 4, 4), ("Page", "function", 6, 8)]),
    ("go", "store.go", '''
package store

import "fmt"

type Key string

type Store struct {
	rows map[Key]string
}

func (s *Store) Get(k Key) (string, bool) {
	v, ok := s.rows[k]
	return v, ok
}

func (p Pair[K]) First() K { return p.a }

func New() *Store {
	return &Store{rows: map[Key]string{"}": "{"}}
}
''', [("<module>", "module", 2, 4), ("Key", "type", 6, 6), ("Store", "type", 8, 10), ("Store.Get", "function", 12, 15), ("Pair.First", "function", 17, 17), ("New", "function", 19, 21)]),
    ("rust", "shape.rs", '''
use std::fmt;

pub struct Circle { r: f64 }

pub enum Kind { Small, Large(char) }

pub trait Area {
    fn area(&self) -> f64;
}

impl<'a> Area for Circle {
    fn area(&self) -> f64 {
        let c = '{';
        self.r
    }
}

mod inner {
    pub(crate) fn twice(x: i32) -> i32 { 2 * x }
}
''', [("<module>", "module", 2, 2), ("Circle", "type", 4, 4), ("Kind", "type", 6, 6), ("Area", "class", 8, 8), ("Area.area", "function", 9, 10), ("Circle", "class", 12, 12),
      ("Circle.area", "function", 13, 17), ("inner", "class", 19, 19), ("inner.twice", "function", 20, 21)]),
    ("java", "Stock.java", '''
package shop;

public class Stock implements Counted {
    private final int[] counts = {1, 2};

    @Override
    public int count(int part) throws Missing {
        if (part < 0) { throw new Missing("}"); }
        return counts[part];
    }

    Stock(int n) { super(n); }

    enum Level { LOW, HIGH }
}

interface Counted {
    int count(int part) throws Missing;
}
''', [("<module>", "module", 2, 2), ("Stock", "class", 4, 6), ("Stock.count", "function", 7, 11), ("Stock.Stock", "function", 13, 13), ("Stock.Level", "type", 15, 16),
      ("Counted", "class", 18, 18), ("Counted.count", "function", 19, 20)]),
    ("csharp", "Mail.cs", '''
using System;

namespace Post.Office
{
    public delegate void Sent(string to);

    public class Mail<T> where T : class
    {
        public string To { get; set; }

        public Mail(string to) : base(to) { To = to; }

        public int Size() => To.Length;
    }

    public enum Stamp { First, Second }
}
''', [("<module>", "module", 2, 2), ("Post.Office", "class", 4, 5), ("Post.Office.Sent", "type", 6, 6), ("Post.Office.Mail", "class", 8, 11), ("Post.Office.Mail.Mail", "function", 12, 12),
      ("Post.Office.Mail.Size", "function", 14, 15), ("Post.Office.Stamp", "type", 17, 18)]),
    ("ruby", "stack.rb", '''
require "set"

module Tools
  class Stack
    attr_reader :items

    def push(x)
      @items << x if x
      items.each do |i|
        puts "end"
      end
    end

    def self.of(*all)
      new(all)
    end
  end
end

def top(s) = s.items.last
''', [("<module>", "module", 2, 2), ("Tools", "class", 4, 4), ("Tools.Stack", "class", 5, 7), ("Tools.Stack.push", "function", 8, 13), ("Tools.Stack.of", "function", 15, 19),
      ("top", "function", 21, 21)]),
    ("c", "queue.c", '''
#include <stdlib.h>
#define LAST(q) ((q)->n - 1)

typedef struct {
    int n;
} Queue;

enum Mode { FIFO, LIFO };

static int *front(Queue *q)
{
    return q->n ? malloc('}') : 0;
}
''', [("<module>", "module", 2, 3), ("Queue", "type", 5, 7), ("Mode", "type", 9, 9), ("front", "function", 11, 14)]),
    ("cpp", "grid.cpp", '''
namespace math {

template <typename T>
class Grid : public Base {
public:
    explicit Grid(int n) : n_(n) {}
    T at(int i) const { return cells_[i]; }
private:
    int n_;
};

struct Point { int x, y; };

}

template <typename T>
int math::Grid<T>::size() const {
    return n_;
}
''', [("math", "class", 2, 3), ("math.Grid", "class", 4, 6), ("math.Grid.Grid", "function", 7, 7), ("math.Grid.at", "function", 8, 8), ("math.Grid", "class", 9, 11),
      ("math.Point", "type", 13, 13), ("math", "class", 15, 15), ("math::Grid<T>::size", "function", 17, 20)]),
    ("php", "cart.php", '''<html>}
<?php
namespace Shop;

interface Priced {
    public function price(): float;
}

abstract class Cart implements Priced {
    private array $items = [];

    #[Pure]
    public function price(): float {
        return array_sum($this->items); // }
    }
}

enum State { case Open; case Paid; }

function total(Cart $c): float { return $c->price(); }
''', [("<module>", "module", 1, 3), ("Priced", "class", 5, 5), ("Priced.price", "function", 6, 7), ("Cart", "class", 9, 11), ("Cart.price", "function", 12, 16), ("State", "type", 18, 18),
      ("total", "function", 20, 20)]),
]


def _oracle(want) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', {a}, {b})" for s, k, a, b in want) + ") t(symbol, kind, start_line, end_line)"


def _query(name: str, path: str, source: str):
    def run(spark, d):
        rows = spark.createDataFrame([(path, source)], "path string, text string")
        return chunking.chunk_files(rows).select("symbol", "kind", "start_line", "end_line")

    run.__name__ = f"chunks_{name}"
    return run


for _name, _path, _source, _want in SAMPLES:
    register(f"chunks_{_name}", _oracle(_want))(_query(_name, _path, _source))
