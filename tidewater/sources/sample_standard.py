"""A made-up standard in the layout of the loaders, for queries and tests. It is no copy of a published one."""

from __future__ import annotations

import csv
import os

#: dataset, name, label, type, order, role, core
SAMPLE = [
    ("LI", "ORDKEY", "Order Key", "Num", 1, "Identifier", "Req"), ("LI", "LINENO", "Line Number", "Num", 2, "Identifier", "Req"), ("LI", "RETFLAG", "Return Flag", "Num", 3, "Qualifier", "Req"),
    ("LI", "COMMENT", "Comment", "Char", 4, "", "Req"), ("LI", "QTY", "Quantity", "Num", 5, "Topic", "Exp"), ("NA", "NKEY", "Nation Key", "num", 1, "Identifier", "Req"), ("NA", "NNAME", "Nation Name", "Char", 0, "Topic", "Perm"),
]


def write_sample(folder: str, publishing_set: str = "SDTM") -> str:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/metadata.toml", "w") as f:
        f.write(f'[standard]\nname = "Sample"\nversion = "1.0"\npublishing_set = "{publishing_set}"\n')
    adam = publishing_set.upper() == "ADAM"
    with open(f"{folder}/{'DataStructures' if adam else 'Datasets'}.csv", "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow([f"c{i}" for i in range(6 if adam else 5)])
        for name, label in (("LI", "Line Items"), ("NA", "Nations")):
            out.writerow(["v", name, label, "FINDINGS", "One record per row", ""] if adam else ["v", "Findings", name, label, "One record per row"])
    with open(f"{folder}/Variables.csv", "w", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        width = 12 if adam else 14
        out.writerow([f"c{i}" for i in range(width)])
        for dataset, name, label, kind, order, role, core in SAMPLE:
            row = [""] * width
            places = {1: dataset, 2: role, 3: name, 4: label, 5: kind, 10: core} if adam else {1: order or "x", 3: dataset, 4: name, 5: label, 6: kind, 11: role, 13: core}
            for i, value in places.items():
                row[i] = value
            out.writerow(row)
        out.writerow([""] * width)
    return folder
