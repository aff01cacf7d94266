"""DataFrame to DataFrame operators over the workbook model."""
