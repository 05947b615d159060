"""A small project, and what was read off it by hand."""

#: A small project, as documents hold no code: path to text.
PROJECT = {
    "shop/cart.ts": 'import { Line } from "./prices"\n\nexport const addLine = async (amount: number): Promise<Line[]> => {\n  if (amount < 1) return []\n  return fetchLines(amount)\n}\n\nfunction fetchLines(n: number) {\n  return n > 10 ? [] : []\n}\n',
    "shop/prices.ts": 'export interface Line { code: string; cents: number[] }\nexport type Currency = "eur" | "usd"\ninterface Rounding { step: number }\n',
    "shop/LineTable.tsx": 'import React from "react"\nimport { addLine } from "./cart"\nimport type { Line } from "./prices"\n\nexport function LineTable({ lines }: { lines: Line[] }) {\n  const shown = useSorted(lines)\n  return <ul>{shown.map((i) => <li key={i.code}>if {i.code} it</li>)}</ul>\n}\n',
}
#: What stands in it, read off by hand: (path, kind, nth, name, first line, last line). Declared functions come before arrows, interfaces before aliases.
DECLARED = (
    ("shop/cart.ts", "function", 1, "addLine", 3, 6),
    ("shop/cart.ts", "function", 0, "fetchLines", 8, 10),
    ("shop/cart.ts", "import", 0, "./prices", None, None),
    ("shop/cart.ts", "export", 0, "addLine", None, None),
    ("shop/cart.ts", "cyclomatic", 0, "3", None, None),
    ("shop/prices.ts", "type", 0, "Line", 1, 1),
    ("shop/prices.ts", "type", 2, "Currency", 2, 2),
    ("shop/prices.ts", "type", 1, "Rounding", 3, 3),
    ("shop/prices.ts", "export", 0, "Line", None, None),
    ("shop/prices.ts", "export", 1, "Currency", None, None),
    ("shop/prices.ts", "cyclomatic", 0, "1", None, None),
    ("shop/LineTable.tsx", "function", 0, "LineTable", 5, 8),
    ("shop/LineTable.tsx", "component", 0, "LineTable", None, None),
    ("shop/LineTable.tsx", "component", 1, "LineTable", None, None),
    ("shop/LineTable.tsx", "import", 0, "react", None, None),
    ("shop/LineTable.tsx", "import", 1, "./cart", None, None),
    ("shop/LineTable.tsx", "import", 2, "./prices", None, None),
    ("shop/LineTable.tsx", "export", 0, "LineTable", None, None),
    ("shop/LineTable.tsx", "export", 1, "LineTable", None, None),
    ("shop/LineTable.tsx", "export", 2, "LineTable", None, None),
    ("shop/LineTable.tsx", "cyclomatic", 0, "1", None, None),
)
