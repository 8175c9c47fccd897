"""Document-layout ETL and OCR-quality analytics as PySpark DataFrame operators."""
