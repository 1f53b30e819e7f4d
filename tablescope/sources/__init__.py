"""Reading and writing: CSV files, folders, catalogue records, analysis results."""
