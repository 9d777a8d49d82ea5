"""Schemas of the extraction tree and of the catalog's tables."""

PAGE_ELEMENT = "struct<type: string, bbox: array<double>, bbox_pixels: array<int>, label: string, description: string, latex: string, search_text: string, crop_path: string, rendered_path: string>"
PAGE_JSON = (
    f"page_number int, image string, annotated_image string, width int, height int, text string, text_length int, elements array<{PAGE_ELEMENT}>, "
    "extraction_time_seconds double, extracted_at string, summary string, keywords array<string>"
)
DOCUMENT_JSON = (
    "document string, source_file string, source_path string, total_pages int, extracted_pages array<int>, extracted_count int, model string, "
    "extraction_date string, last_updated string, summary string, keywords array<string>, license string, title string"
)
LEGACY_ELEMENT = "struct<type: string, bbox_1000: array<double>, bbox_pixels: array<int>, label: string, description: string, crop_path: string>"
LEGACY_JSON = f"document string, source_file string, extraction_date string, model string, pages array<struct<page_number: int, image: string, width: int, height: int, text: string, elements: array<{LEGACY_ELEMENT}>, total_page_time_seconds: double>>"

DOCUMENTS = "id long, slug string, title string, source_file string, extraction_date timestamp_ntz, model string, metadata map<string, string>, summary string, keywords array<string>, license string"
PAGES = "id long, document_id long, page_number int, image_path string, annotated_image_path string, full_text string, summary string, keywords array<string>, width int, height int"
CHUNKS = "id long, document_id long, page_id long, content string, chunk_index int, start_char int, end_char int, embedding array<float>"
ELEMENTS = (
    "id long, document_id long, page_id long, element_type string, label string, description string, search_text string, latex string, "
    "crop_path string, rendered_path string, bbox_pixels array<int>, embedding array<float>"
)
