"""Word lists that results depend on."""

# English and Chinese stop words.
STOP_EN = ("a", "an", "the", "is", "are", "was", "were", "to", "of", "for", "in", "on", "at", "and", "or", "if", "it", "this", "that", "with", "as", "be", "by", "from", "we", "you", "i", "they", "he", "she", "but", "not", "do", "did", "done", "have", "has", "had")
STOP_ZH = ("的", "了", "和", "是", "在", "我", "你", "他", "她", "它", "我们", "你们", "他们", "这", "那", "一个", "一下", "然后", "以及", "或者", "并且", "如果", "因为", "所以")
STOP = frozenset(STOP_EN + STOP_ZH)

# Hints that are looked for as substrings.
DIRECTIONAL = ("before", "after", "cause", "because", "next", "previous", "parent", "child", "related", "之前", "之后", "原因", "导致", "后续", "上一步", "下一步", "关联", "依赖")
INCOMING = ("before", "previous", "之前", "上一步")
OUTGOING = ("after", "next", "之后", "后续", "下一步")
CAUSE_TYPE = ("cause", "because", "原因", "导致")
PARENT_TYPE = ("parent", "父", "上层")
CHILD_TYPE = ("child", "子任务", "下层")
IMPORTANT = ("critical", "p0", "incident", "outage", "rollback", "blocked", "sev1", "sev0", "故障", "事故", "回滚", "阻塞", "紧急", "严重", "生产", "线上")
CONFLICT = ("but", "however", "instead", "contradict", "conflict", "not", "但是", "不过", "冲突", "矛盾", "相反", "而不是", "并非")
TRANSITION = ("然后", "接着", "后续", "下一步", "阶段", "phase", "then", "next", "after that", "follow-up")
CAUSE = ("because", "cause", "reason", "导致", "因为", "原因", "由于", "root cause")
OUTCOME = ("issue", "problem", "bug", "error", "failure", "incident", "故障", "问题", "失败", "异常", "中断", "回滚")
TRIGGER = ("issue", "problem", "bug", "error", "failure", "incident", "timeout", "retry", "依赖", "超时", "重试", "故障", "问题", "失败", "异常")
SUBTASK = ("子任务", "subtask", "拆分", "步骤")
TASK = ("任务", "task", "目标", "milestone")
ALTERNATIVE = ("备选", "替代", "回滚", "plan b", "option", "alternative")
TOPIC_PREFIXES = ("另外", "另一方面", "还有", "接下来", "下面", "那么", "好了", "换个话题", "顺便", "对了", "说起", "问一下", "再问", "by the way", "anyway", "moving on", "next,", "now,", "ok,", "alright,", "let me ask", "one more thing", "also,")

ROLES = ("system", "user", "assistant", "tool")
# Relation types in the order that numbers them, and what other spellings stand for.
RELATION_TYPES = ("CAUSES", "FOLLOWS", "PARENT_TASK", "CHILD_TASK", "ALTERNATIVE", "CONTEXT", "SNAPSHOT_OF_FILE", "FILE_MENTIONS_BLOCK")
FILE_TYPES = ("SNAPSHOT_OF_FILE", "FILE_MENTIONS_BLOCK")
RELATION_ALIASES = {"cause": "CAUSES", "causes": "CAUSES", "follows": "FOLLOWS", "follow": "FOLLOWS", "parent": "PARENT_TASK", "child": "CHILD_TASK", "alternative": "ALTERNATIVE", "context": "CONTEXT"}
# Confidence of an edge that has none, and how much a type boosts a history match.
DEFAULT_CONFIDENCE = {"FOLLOWS": 0.9, "CAUSES": 0.75, "PARENT_TASK": 0.7, "CHILD_TASK": 0.7, "ALTERNATIVE": 0.6, "SNAPSHOT_OF_FILE": 0.58, "FILE_MENTIONS_BLOCK": 0.57}
OTHER_CONFIDENCE = 0.55
TYPE_WEIGHT = {"FOLLOWS": 0.08, "CAUSES": 0.07, "PARENT_TASK": 0.06, "CHILD_TASK": 0.06, "CONTEXT": 0.05}
OTHER_WEIGHT = 0.04
