"""Schemas of the files; nothing is inferred."""

SAMPLE = "dataset string, sample_id string, image string, gt_html string, meta map<string,string>"
PREDICTION = (
    "dataset string, run_id string, sample_id string, seq bigint, backend_tag string, base_url string, prompt_id string, input_image_path string, min_image_side int, long_image_side int, "
    "preprocess_profile string, num_ctx int, run_ok boolean, conversion_ok boolean, raw_path string, raw_json_path string, html_path string, html string, seconds double, error string, "
    "removed_caption_note_rows int, response_chars int, thinking_chars int"
)
TOKENS = "filename string, split string, imgid bigint, html struct<structure:struct<tokens:array<string>>,cells:array<struct<tokens:array<string>>>>"
ITEM = "id string, gt_html string, html string, table_html string, image_data_uri string, image string, src string"
