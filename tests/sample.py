"""An invented sales table: currency text, two categories, four months, one repeated row."""

HEADER = "Date,Product,Category,Sales,Quantity"

ROWS = """2023-05-03,Copper Kettle,Kitchen,$84.50,2
2023-05-09,Oak Stool,Furniture,"$1,120.00",1
2023-05-21,Tea Towel,Kitchen,$7.25,12
2023-06-02,Oak Stool,Furniture,$560.00,4
2023-06-02,Oak Stool,Furniture,$560.00,4
2023-06-17,Wall Shelf,Furniture,$210.40,3
2023-07-01,Copper Kettle,Kitchen,$84.50,7
2023-07-08,Tea Towel,Kitchen,$7.25,9
2023-07-29,Wall Shelf,Furniture,$210.40,2
2023-08-11,Egg Timer,Kitchen,$15.75,5
2023-08-12,Copper Kettle,Kitchen,$84.50,1
2023-08-30,Egg Timer,Kitchen,$15.75,8
2023-08-31,Tea Towel,Kitchen,$7.25,6
"""


def write_sample(folder):
    path = folder / "sales.csv"
    path.write_text(f"{HEADER}\n{ROWS}")
    return str(path)
