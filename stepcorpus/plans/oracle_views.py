"""DuckDB twins of ``views``: common table expressions for the oracle SQL."""

from __future__ import annotations

from stepcorpus import settings as S
from stepcorpus.plans.views import IMAGE_BASE, PADS_PER_SAMPLE, PATCHES_PER_IMAGE


def q(s: str) -> str:
    """A SQL string literal (DuckDB does not process backslashes)."""
    return "'" + s.replace("'", "''") + "'"


def sql_text(s: str) -> str:
    """A SQL expression for a Python string that may hold newlines."""
    parts = s.split("\n")
    out = []
    for i, p in enumerate(parts):
        if p:
            out.append(q(p))
        if i < len(parts) - 1:
            out.append("chr(10)")
    return "(" + " || ".join(out or ["''"]) + ")"


TOKEN_RE = q(S.TOKEN_PATTERN)
STEP_RE = q(S.STEP_PATTERN_RE2)

VIEWS: dict[str, tuple[list[str], str]] = {
    "conv_nested": ([], f"""
select conv_id, 'img/' || conv_id || '.png' as image,
  list({{'from': case role when 'user' then 'human' when 'assistant' then 'gpt' else role end,
        'value': case when role = 'user' then '<image>' || chr(10) || text else text end}}
       order by turn) as conversations
from conversations group by conv_id"""),
    "pairs": ([], """
select conv_id,
  min_by(case when role = 'user' then text end, case when role = 'user' then turn end) as q,
  min_by(case when role = 'assistant' then text end, case when role = 'assistant' then turn end) as a
from conversations group by conv_id"""),
    "instr": ([], """
select conv_id, string_agg('Step ' || (turn + 1) || ': ' || text || ' и ' ||
    case when turn % 3 = 0 then '<neg>' when turn % 3 = 1 then '<pos>' else '' end, chr(10) order by turn)
  as instruction
from conversations where role <> 'system' group by conv_id"""),
    "step_records": ([], """
select conv_id, case conv_id % 5 when 0 then null when 1 then ''
  when 2 then 'MathV-360k/img/' || conv_id || '.png' when 3 then 'img/' || conv_id || '.png'
  else 'data_images/img/' || conv_id || '.png' end as image_url
from (select distinct conv_id from conversations)"""),
    "step_records_full": (["step_records", "instr"], """
select r.conv_id, r.image_url, i.instruction from step_records r left join instr i using (conv_id)"""),
    "manifest": ([], f"""
select distinct '{IMAGE_BASE}/data_images/img/' || conv_id || '.png' as path from conversations
where substr(md5('image:' || conv_id), 1, 1) not in ('0', '1')"""),
    "answered_pairs": (["pairs"], f"""
select conv_id, case when q is null or a is null then {sql_text(S.FALLBACK_STAGE2_USER)} else q end as q,
  case when q is null or a is null then {sql_text(S.FALLBACK_STAGE2_ANSWER)} else a end as a from pairs"""),
    "token_arrays": (["answered_pairs"], f"""
select conv_id as sample_id, regexp_extract_all(
  {sql_text(f"{S.IM_START}system{chr(10)}{S.SYSTEM_STAGE1}{S.IM_END}{chr(10)}{S.IM_START}user{chr(10)}"
            + S.IMAGE_PAD * PADS_PER_SAMPLE + chr(10))}
  || q || {sql_text(f"{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}")} || a || {sql_text(S.IM_END + chr(10))},
  {TOKEN_RE}, 0) as toks
from answered_pairs"""),
    "tokens": (["token_arrays"], """
select sample_id, unnest(range(len(toks))) as pos, unnest(toks) as tok from token_arrays"""),
    "patches": ([], f"""
select cast(floor(vec_id / {PATCHES_PER_IMAGE}) as bigint) as image_id,
  cast(vec_id % {PATCHES_PER_IMAGE} as integer) as patch_idx, embedding from embeddings"""),
    "step_features": ([], """
select vec_id, embedding, quality as label from embeddings join labels on vec_id = doc_id"""),
    "scores": ([], """
select vec_id as grp, cast(unnest(range(len(embedding))) as bigint) as item,
  cast(unnest(embedding) as double) as score from embeddings"""),
    "metrics_log": ([], """
select user_id as run_id, event_id as step, value as eval_loss from events where event_type = 'view'"""),
}


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies) in
    dependency order, then any extra ``(name, sql)`` CTEs, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} as ({VIEWS[n][1].strip()})" for n in order]
    ctes += [f"{n} as ({s.strip()})" for n, s in (extra or [])]
    if not ctes:
        return body.strip()
    return "with " + ",\n".join(ctes) + "\n" + body.strip()


def _sql_join(left: str, part: str) -> str:
    from stepcorpus.plans.registry import sql_join
    return sql_join(left, part)


def resolve_sql(url: str, base: str) -> str:
    images = _sql_join(q(base), q(S.PATH_IMAGES_DIR))
    rest = f"substr({url}, {len(S.PATH_PREFIX_DATASET) + 1})"
    return (f"(case when starts_with({url}, {q(S.PATH_PREFIX_DATASET)}) then {_sql_join(images, rest)} "
            f"when not starts_with({url}, {q(S.PATH_PREFIX_IMAGES)}) then {_sql_join(images, url)} "
            f"else {_sql_join(q(base), url)} end)")


def vocab_sql(occurrences: str) -> str:
    """Vocabulary CTE body over a query yielding one ``token`` per occurrence."""
    k = len(S.SPECIAL_TOKENS)
    specials = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(S.SPECIAL_TOKENS))
    in_list = ", ".join(q(t) for t in S.SPECIAL_TOKENS)
    return f"""
select token, token_id, n from (
  select s.token, cast(s.token_id as bigint) as token_id, coalesce(c.n, 0) as n
  from (values {specials}) s(token, token_id)
  left join (select token, count(*) as n from ({occurrences}) group by token) c using (token)
  union all
  select token, cast({k - 1} + row_number() over (order by n desc, token) as bigint) as token_id, n
  from (select token, count(*) as n from ({occurrences}) where token not in ({in_list}) group by token))"""


def tokens_of(text_sql: str) -> str:
    return f"regexp_extract_all({text_sql}, {TOKEN_RE}, 0)"


def _stage1_sql() -> str:
    from stepcorpus.plans.registry import sql_join
    sys_user = sql_text(f"{S.IM_START}system\n{S.SYSTEM_STAGE1}{S.IM_END}\n{S.IM_START}user\n")
    gen = sql_text(f"{S.IM_END}\n{S.IM_START}assistant\n")
    pads = q(S.IMAGE_PAD * S.IMAGE_PAD_NUM)
    fb_q = (f"{S.IM_START}system\n{S.SYSTEM_STAGE1}{S.IM_END}\n{S.IM_START}user\n"
            f"{S.FALLBACK_STAGE1_USER}{S.IM_END}\n{S.IM_START}assistant\n").replace(S.IMAGE_TAG, S.IMAGE_PAD * S.IMAGE_PAD_NUM)
    fb_a = S.FALLBACK_STAGE1_ANSWER + S.EOS_TOKEN
    path = sql_join(q(STAGE_IMAGE_ROOT), "c.image")
    return f"""
select conv_id, err as error_reason, err is not null as is_fallback,
  list_concat(q_tok, a_tok) as tokens, cast(len(q_tok) as integer) as n_prompt
from (
  select conv_id, err,
    case when err is null then {tokens_of(f"replace({sys_user} || question || {gen}, '<image>', {pads})")}
         else {tokens_of(sql_text(fb_q))} end as q_tok,
    case when err is null then {tokens_of(f"answer || {q(S.EOS_TOKEN)}")}
         else {tokens_of(sql_text(fb_a))} end as a_tok
  from (
    select *, case when image is null then 'no_image' when n_turns < 2 then 'too_few_turns'
      when question is null or answer is null then 'null_text' when image_missing then 'image_missing' end as err
    from (
      select c.conv_id, c.image, c.conversations[1]['value'] as question, c.conversations[2]['value'] as answer,
        coalesce(len(c.conversations), 0) as n_turns, m.path is null as image_missing
      from conv_nested c left join manifest m on m.path = {path})))"""


STAGE_IMAGE_ROOT = f"{IMAGE_BASE}/data_images"
VIEWS["stage1_tokens"] = (["conv_nested", "manifest"], _stage1_sql())


def _stage2_sql() -> tuple[str, str, str]:
    from stepcorpus.plans.registry import sql_join
    pads = q(S.IMAGE_PAD * S.IMAGE_PAD_NUM)
    text = (f"{sql_text(f'{S.IM_START}system{chr(10)}{S.SYSTEM_STAGE2}{S.IM_END}{chr(10)}{S.IM_START}user{chr(10)}')}"
            f" || question || {sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')} || answer"
            f" || {sql_text(S.IM_END + chr(10))}")
    fb_q = (f"{S.IM_START}system\n{S.SYSTEM_STAGE2}{S.IM_END}\n{S.IM_START}user\n"
            f"{S.FALLBACK_STAGE2_USER}{S.IM_END}\n").replace(S.IMAGE_TAG, S.IMAGE_PAD * S.IMAGE_PAD_NUM)
    fb = tokens_of(sql_text(fb_q + S.FALLBACK_STAGE2_ANSWER + S.EOS_TOKEN))
    n_fb_q = f"len({tokens_of(sql_text(fb_q))})"
    pad = q(S.PAD_TOKEN)
    path = sql_join(q(STAGE_IMAGE_ROOT), "c.image")
    err = f"""
select t.conv_id, t.toks, case when t.image is null then 'no_image' when t.h is null then 'no_human_turn'
    when t.b is null then 'no_assistant_turn' when t.question is null or t.answer is null then 'null_text'
    when coalesce(u.unclosed, false) then 'unclosed_span' when t.image_missing then 'image_missing' end as err
from s2_text t left join (select conv_id, bool_or(a is not null and e is null) as unclosed from s2_grp group by conv_id) u
  using (conv_id)"""
    base = f"""
select c.conv_id, c.image, c.h, c.b, c.h['value'] as question, c.b['value'] as answer, m.path is null as image_missing
from (select conv_id, image, list_filter(conversations, lambda x: x['from'] = 'human')[1] as h,
        list_filter(conversations, lambda x: x['from'] in ('gpt', 'assistant'))[1] as b from conv_nested) c
left join manifest m on m.path = {path}"""
    full = f"""
select s.conv_id, s.pos, s.tok,
  case when g.a is not null and g.e is not null and s.pos > g.a then s.tok else {pad} end as label_tok
from s2_seg s join s2_grp g using (conv_id, seg) join stage2_err e using (conv_id) where e.err is null
union all
select conv_id, unnest(range(len({fb}))) as pos, unnest({fb}) as tok,
  unnest(list_transform(range(len({fb})), lambda i: case when i < {n_fb_q} then {pad} else ({fb})[i + 1] end)) as label_tok
from stage2_err where err is not null"""
    return base, err, full


def _add_stage2_views() -> None:
    base, err, full = _stage2_sql()
    VIEWS["s2_base"] = (["conv_nested", "manifest"], base)
    VIEWS["s2_text"] = (["s2_base"], f"""
select *, regexp_extract_all(replace({sql_text(f'{S.IM_START}system{chr(10)}{S.SYSTEM_STAGE2}{S.IM_END}{chr(10)}{S.IM_START}user{chr(10)}')}
  || question || {sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')} || answer || {sql_text(S.IM_END + chr(10))},
  '<image>', {q(S.IMAGE_PAD * S.IMAGE_PAD_NUM)}), {TOKEN_RE}, 0) as toks from s2_base""")
    VIEWS["s2_seg"] = (["s2_text"], f"""
select conv_id, pos, tok, coalesce(sum(case when tok = {q(S.IM_END)} then 1 else 0 end)
  over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as seg
from (select conv_id, unnest(range(len(toks))) as pos, unnest(toks) as tok from s2_text)""")
    VIEWS["s2_grp"] = (["s2_seg"], f"""
select conv_id, seg, min(pos) filter (where tok = {q(S.ROLE_ASSISTANT)}) as a,
  max(pos) filter (where tok = {q(S.IM_END)}) as e from s2_seg group by conv_id, seg""")
    VIEWS["stage2_err"] = (["s2_text", "s2_grp"], err)
    VIEWS["stage2_full"] = (["s2_seg", "s2_grp", "stage2_err"], full)
    VIEWS["stage2_long"] = (["stage2_full"], """
select conv_id, pos, tok as input_tok, label_next as label_tok from (
  select *, lead(label_tok) over (partition by conv_id order by pos) as label_next,
    count(*) over (partition by conv_id) as n from stage2_full) where pos < n - 1""")


_add_stage2_views()


def _add_stage3_views() -> None:
    from stepcorpus.operators.prompts import stage3_prompt_prefix
    resolved = resolve_sql("image_url", IMAGE_BASE)
    VIEWS["stage3_valid"] = (["step_records_full", "manifest"], f"""
select conv_id, image_url, instruction, {resolved} as full_image_path from step_records_full
where coalesce(image_url, '') <> '' and {resolved} in (select path from manifest)""")
    prompt = (f"{sql_text(stage3_prompt_prefix())} || coalesce(instruction, 'None') || "
              f"{sql_text(f'{S.IM_END}{chr(10)}{S.IM_START}assistant{chr(10)}')}")
    VIEWS["stage3_tokens"] = (["stage3_valid"], f"""
select conv_id, instruction, {tokens_of(prompt)} as tokens from stage3_valid""")
    VIEWS["stage3_vocab"] = (["stage3_tokens"], vocab_sql("select unnest(tokens) as token from stage3_tokens"))
    VIEWS["stage3_ids"] = (["stage3_tokens", "stage3_vocab"], """
select l.conv_id, l.pos, v.token_id from (select conv_id, unnest(range(len(tokens))) as pos, unnest(tokens) as token
  from stage3_tokens) l join stage3_vocab v using (token)""")
    VIEWS["stage3_split"] = (["stage3_valid"], """
select conv_id, case when row_number() over (order by md5('42:' || conv_id), conv_id)
    <= floor(count(*) over () * cast(0.05 as double)) then 'validation' else 'train' end as split
from stage3_valid""")
    VIEWS["stage3_batches"] = (["stage3_split", "stage3_tokens"], """
select epoch, cast((rk - 1) // 4 as bigint) as batch_id, cast((rk - 1) % 4 as integer) as slot, conv_id, n,
  max(n) over (partition by epoch, (rk - 1) // 4) as max_len
from (select epoch, conv_id, n,
        row_number() over (partition by epoch order by md5('42:' || epoch || ':' || conv_id), conv_id) as rk
      from (select s.conv_id, len(t.tokens) as n, unnest(range(2)) as epoch
            from stage3_split s join stage3_tokens t using (conv_id) where s.split = 'train'))""")
    VIEWS["stage3_validation"] = (["stage3_split", "stage3_tokens"], """
select cast((rk - 1) // 4 as bigint) as batch_id, cast((rk - 1) % 4 as integer) as slot, conv_id, max(n) over (partition by (rk - 1) // 4) as max_len
from (select s.conv_id, len(t.tokens) as n, row_number() over (order by md5('42:0:' || s.conv_id), s.conv_id) as rk
      from stage3_split s join stage3_tokens t using (conv_id) where s.split = 'validation')""")
    VIEWS["stage3_steps"] = (["stage3_tokens"], f"""
select s.conv_id, cast(s.step_no as integer) as step_no,
  cast(len(regexp_extract_all(substr(s.instruction, 1, instr(s.instruction, s.header) - 1), {TOKEN_RE}, 0)) as integer) as token_idx, s.label
from (select conv_id, instruction, unnest(range(len(hs))) as step_no, unnest(hs) as header,
        unnest(list_transform(cs, lambda c: case when contains(c, '<pos>') then 1 when contains(c, '<neg>') then 0 else 1 end)) as label
      from (select conv_id, instruction, regexp_extract_all(instruction, {q(S.STEP_PATTERN_RE2)}, 1) as hs,
              regexp_extract_all(instruction, {q(S.STEP_PATTERN_RE2)}, 0) as cs from stage3_tokens)) s""")


_add_stage3_views()
