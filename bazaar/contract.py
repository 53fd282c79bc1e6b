"""Names and types at the edges of the pipeline.

Raw files and messages carry titled names (``Customer ID``); inside, every column is snake_case. ``to_snake`` is applied
once when a raw table is read, ``to_titles`` once when a table leaves in the titled form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of the six raw tables, every one a string.
RAW_COLUMNS = {
    "customers": (
        "Customer ID", "Name", "Email", "Telephone", "City", "Country", "Gender", "Date Of Birth", "Job Title",
    ),
    "products": (
        "Product ID", "Category", "Sub Category", "Description PT", "Description DE", "Description FR",
        "Description ES", "Description EN", "Description ZH", "Color", "Sizes", "Production Cost",
    ),
    "stores": (
        "Store ID", "Country", "City", "Store Name", "Number of Employees", "ZIP Code", "Latitude", "Longitude",
    ),
    "employees": ("Employee ID", "Store ID", "Name", "Position"),
    "discounts": ("Start", "End", "Discont", "Description", "Category", "Sub Category"),
    "transactions": (
        "Invoice ID", "Line", "Customer ID", "Product ID", "Size", "Color", "Unit Price", "Quantity", "Date",
        "Discount", "Line Total", "Store ID", "Employee ID", "Currency", "Currency Symbol", "SKU",
        "Transaction Type", "Payment Method", "Invoice Total",
    ),
}

# Words of a titled name that are not simply capitalised, and the misspelt raw column.
UPPER_WORDS = {"id", "usd", "fx", "sku", "zip", "pt", "de", "fr", "es", "en", "zh"}
RAW_SPELLING = {"Discont": "discount"}

TABLES = tuple(RAW_COLUMNS)

# Money is exact. Raw values keep ten digits after the point, so that rules see them unrounded, and eighteen before it; dollar
# values stay in one machine word.
PRICE = T.DecimalType(28, 10)
MONEY = T.DecimalType(18, 2)


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS[table]])


def snake_name(title: str) -> str:
    return RAW_SPELLING.get(title, title.lower().replace(" ", "_"))


def title_name(snake: str) -> str:
    return " ".join(w.upper() if w in UPPER_WORDS else w.capitalize() for w in snake.split("_"))


def to_snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake_name(c) for c in df.columns})


def to_titles(df: DataFrame) -> DataFrame:
    """A table under the titled names that raw files, dashboards and older SQL use (``Line Total USD``)."""
    return df.withColumnsRenamed({c: title_name(c) for c in df.columns})


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Money leaves as double; sums are done before this, on exact decimals."""
    return df.withColumns(
        {f.name: df[f.name].cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    )
