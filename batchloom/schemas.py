"""Table schemas, vocabularies and limits."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ValidationError

# Fixed values of the data model.
QUEUE_STATUSES = ("active", "paused", "stopped")
REMOTE_STATUSES = ("validating", "failed", "in_progress", "finalizing", "completed", "expired", "cancelling", "cancelled")
TERMINAL_STATUSES = ("completed", "failed", "expired", "cancelled")
ENDPOINTS = ("/v1/responses", "/v1/chat/completions", "/v1/embeddings", "/v1/completions", "/v1/moderations")
HEALTH_COMPONENTS = ("tables", "tokenizer", "config", "secrets", "checkpoints")
DEFAULT_TENANT = "standalone"
MAX_METADATA_BYTES = 65_536
MAX_JOBS, MAX_CANDIDATES = 100, 400
RETRY_STATUSES = (408, 425, 429, 502, 503, 504)

TABLES = {
    "com_config": "config_key string, config_value string, config_description string, updated_at timestamp",
    "com_secrets": "secret_key string, secret_value string, is_encrypted boolean, updated_at timestamp",
    "llm_queues": "queue_uuid string, queue_name string, queue_status string, queue_description string, created_at timestamp, updated_at timestamp",
    "llm_batches": "batch_uuid string, queue_uuid string, batch_name string, batch_status string, model_name string, total_requests int, completed_requests int, failed_requests int, total_tokens long, max_tokens_per_batch long, input_file_path string, output_file_path string, error_message string, created_at timestamp, updated_at timestamp, started_at timestamp, completed_at timestamp",
    "llm_remote_batch_jobs": "remote_job_uuid string, tenant_scope string, endpoint_alias string, remote_batch_id string, observation_order long, input_file_id string, batch_endpoint string, batch_status string, output_file_id string, error_file_id string, total_requests long, total_requests_known boolean, completed_requests long, failed_requests long, provider_metadata string, first_seen_at timestamp, last_observed_at timestamp, terminal_at timestamp, updated_at timestamp",
    "llm_batch_file_payloads": "file_uuid string, file_id string, content struct<text: string, line_count: long>, created_at timestamp, updated_at timestamp",
    "llm_batch_files": "file_uuid string, batch_uuid string, queue_uuid string, file_path string, payload_file_id string, storage_ref string, part_index int, request_count int, total_tokens long, created_at timestamp, uploaded_at timestamp",
    "llm_requests": "request_uuid string, batch_uuid string, custom_request_id string, system_prompt string, user_prompt string, model_name string, prompt_tokens int, completion_tokens int, total_tokens int, request_status string, retry_count int, max_retries int, response_content string, response_metadata string, error_code string, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp, batch_file_uuid string",
    "llm_jsonl_lines": "line_uuid string, payload_file_id string, request_uuid string, sequence_no int, line_text string, created_at timestamp",
    "llm_endpoints": "endpoint_uuid string, endpoint_alias string, base_url string, provider string, active boolean, created_at timestamp, updated_at timestamp",
    "llm_endpoint_models": "endpoint_uuid string, model_id string, tokenizer_model string, model_mode string, last_verified_at timestamp",
    "llm_result_stream_checkpoints": "result_checkpoint_uuid string, tenant_scope string, checkpoint_consumer_name string, endpoint_alias string, remote_batch_id string, schema_version int, file_kind string, file_id string, file_line_number long, batch_line_count long, record_count long, prefix_sha256 string, created_at timestamp, updated_at timestamp",
}


def exact_positive(name: str, value: object) -> int:
    """value, if it is an int (no bool) above zero."""
    if type(value) is not int or value <= 0:
        raise ValidationError(f"{name} must be a positive integer", value=value)
    return value


@dataclass(frozen=True)
class Limits:
    """What one part of a batch may hold, and how many parts a job takes."""

    per_batch: int = 5_000_000_000
    buffer_percentage: int = 5
    max_records: int = 100_000
    max_bytes: int = 200 * 1024 * 1024
    max_files: int = 500
    internal_chunk: int = 50

    def __post_init__(self) -> None:
        for name in ("per_batch", "max_records", "max_bytes", "max_files", "internal_chunk"):
            exact_positive(name, getattr(self, name))
        if type(self.buffer_percentage) is not int or not 0 <= self.buffer_percentage <= 50:
            raise ValidationError("buffer_percentage must be an integer from 0 to 50", value=self.buffer_percentage)

    def effective(self, runtime: int | None = None) -> int:
        """Tokens of a part: the limit less its buffer, and no more than a limit given at run time."""
        own = self.per_batch * (100 - self.buffer_percentage) // 100
        return own if runtime is None else min(own, exact_positive("runtime limit", runtime))
