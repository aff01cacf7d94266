"""tabloom: spreadsheet-shaped analytics expressed as Spark DataFrames.

Sub-packages
------------
``functions``  column expressions and Arrow functions (A1 references, formula language)
``operators``  DataFrame -> DataFrame operators (regions, blocks, edges, graph, diagnostics)
``sources``    workbook readers and writers (OOXML data source, table to cell grids)
``plans``      named queries with their SQL oracles, and the workbook facade
``streaming``  incremental refresh on Structured Streaming
"""
